"""The shape of the plans: shuffles, pushed filters, pruned columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftline.operators import ledger as L
from driftline.operators import netchange as N
from driftline.operators import trace as T
from driftline.operators.compare import compare_captures
from driftline.sources import changes
from test_capture_compare import capture, random_capture
from test_net_change import TRUTH, log


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")

    def store(name, df):
        df.write.mode("overwrite").parquet(str(folder / name))
        return spark.read.parquet(str(folder / name))

    return store


@pytest.fixture()
def no_broadcast(spark):
    """Size estimates beyond any broadcast, as with large inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_comparison_shuffles_each_side_once(spark, stored, no_broadcast):
    a, b = stored("a", capture(spark, random_capture(1))), stored("b", capture(spark, random_capture(2)))
    text = plan(compare_captures(a, b))
    records = [line for line in text.splitlines() if "Exchange hashpartitioning(table_name" in line and ", pk#" in line]
    assert len(records) == 2
    # The failures are exploded below the join with the common tables: only they move again.
    lines = text.splitlines()
    explode = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    outer = next(i for i, line in enumerate(lines) if "FullOuter" in line)
    common = next(i for i, line in enumerate(lines) if "SortMergeJoin [table_name" in line and "Inner" in line)
    assert common < explode < outer
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_unique_keys_need_no_aggregate(spark, stored, no_broadcast):
    a = stored("u", capture(spark, random_capture(3)))
    assert "max_by" not in plan(compare_captures(a, a, unique_keys=True))


def test_net_change_reduces_before_its_only_shuffle(spark, stored):
    text = plan(N.net_change(stored("log", log(spark, TRUTH)), ["id"]))
    assert text.count("Exchange") == 1
    assert text.index("partial_min_by") > text.index("Exchange")
    assert "Window" not in text and "collect_list" not in text


def test_ranges_reach_the_scan(spark, stored):
    changes_ = stored("ranged", log(spark, TRUTH))
    bound = F.unhex(F.lit("00000000000000000001"))
    text = plan(changes.scan_changes_after(changes_, bound))
    assert "PushedFilters: [IsNotNull(start_lsn), GreaterThan(start_lsn" in text
    events = stored("events", spark.range(50).select(
        F.lit("s").alias("session_id"), F.col("id").alias("execution_order"), F.lit("x").alias("sql_text"),
        F.col("id").alias("duration"), F.col("id").alias("event_id")))
    page = plan(T.page_events(events, "s", take=5, after=10))
    assert "GreaterThan(execution_order,10)" in page and "TakeOrderedAndProject" in page
    slowest = plan(T.slowest_events(events).select("event_id", "duration"))
    assert "sql_text" not in slowest and "ReadSchema: struct<" in slowest
    assert "TakeOrderedAndProject" in slowest


def test_details_are_counted_before_they_join(spark, stored, no_broadcast):
    details = stored("details", spark.range(100).select((F.col("id") % 3).alias("k")))
    headers = stored("headers", spark.range(2).select(F.col("id").alias("h")))
    lines = plan(L.orphans(details, headers, "k", "h")).splitlines()
    join = next(i for i, line in enumerate(lines) if "LeftAnti" in line)
    counted = next(i for i, line in enumerate(lines) if "partial_count" in line and i > join)
    assert counted > join


def test_no_plan_uses_python(spark):
    """No query of the audit engine runs Python in its tasks; the text operators in llm may."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "driftline"
    for path in root.rglob("*.py"):
        if path.is_relative_to(root / "llm"):
            continue
        text = path.read_text()
        for word in ("pandas_udf", "applyInPandas", "mapInPandas", ".rdd", "localCheckpoint", "crossJoin", ".toPandas("):
            assert word not in text, (path, word)

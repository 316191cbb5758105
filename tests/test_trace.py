"""Trace rules, ordering, shredding, workload files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import statements as rules
from driftline.functions import text as X
from driftline.operators import trace as T
from driftline.operators.ordering import number_rows
from driftline.sources import trace as sources


def column(spark, values, name="sql_text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def evaluate(spark, values, function):
    rows = column(spark, values).select("i", function(F.col("sql_text")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


CASES = [
    ("", False), ("  \t\n", False), (None, False), ("SELECT 1", False), (" insert into t", True), ("UPDATE sys.x", False),
    ("DELETE FROM cdc.t", False), ("BACKUP DATABASE d", False), ("EXEC usp_x", True), ("EXECUTE usp_x", True),
    ("WITH c AS (SELECT 1) DELETE FROM c", False), ("UPDATE t SET a='__$'", False), ("DROP TABLE t", True),
    ("MERGE INTO t", True), ("create table information_schema_copy (a int)", False), ("ALTER TABLE t", True),
    ("DROP EVENT SESSION extended_events", False), (" DELETE FROM t", True),
]


def test_replayable(spark):
    assert evaluate(spark, [c for c, _ in CASES], rules.is_replayable) == [r for _, r in CASES]


def test_skipped(spark):
    sql = ["", "select 1", "UPDATE sys.t", "UPDATE t SET a_b = 1", "UPDATE t SET axb = 1", None]
    skip = lambda **o: evaluate(spark, sql, lambda c: rules.skip_statement(c, **o))
    assert skip() == [True, True, True, False, False, True]
    assert skip(skip_select=False, skip_system=False) == [True, False, False, False, False, True]
    assert skip(exclude_patterns=["%a_b%", " "]) == [True, True, True, True, False, True]
    assert skip(exclude_patterns=["set a"]) == [True, True, True, True, True, True]
    assert skip(exclude_patterns=["%a_b"]) == [True, True, True, False, False, True]


def test_clean_sql(spark):
    got = evaluate(spark, [
        "  UPDATE t\n  SET a = 1  ", "UPDATE t SET a=1;", "delete from t GO", "DROP TABLE cargo", "EXEC usp_x",
        "UPDATE t SET a = 1 -- Exec sp_executesql N'x'\nWHERE b = 2", "", None, "merge into t\tusing s"], X.clean_sql)
    assert got == ["UPDATE t SET a = 1;", "UPDATE t SET a=1;", "delete from t GO", "DROP TABLE cargo;", "EXEC usp_x",
                   "UPDATE t SET a = 1 WHERE b = 2;", "", "", "merge into t using s;"]


@pytest.mark.parametrize("pattern,text,like,wild", [
    ("a%", "ABC", True, False), ("a*", "ABC", False, True), ("a?c", "abc", False, True), ("a.c", "abc", False, False),
    ("100%", "100 (percent)", True, False), ("[x]*", "[x]y", False, True), ("a_c", "abc", False, False),
])
def test_patterns(spark, pattern, text, like, wild):
    row = column(spark, [text]).select(X.like_match(F.col("sql_text"), pattern).alias("l"),
                                       X.wildcard_match(F.col("sql_text"), pattern).alias("w")).first()
    assert (row.l, row.w) == (like, wild)


def test_numbering_equals_a_window_with_a_hot_group(spark, listed):
    rng = random.Random(3)
    data = [(None if g == 9 else f"s{g if rng.random() < .5 else 0}", rng.randrange(5), i)
            for i in range(400) for g in [rng.randrange(10)]]
    df = spark.createDataFrame(data, "session_id string, event_time int, event_id int").repartition(4)
    from pyspark.sql import Window
    window = Window.partitionBy("session_id").orderBy("event_time", "event_id")
    expected = df.withColumn("n", F.row_number().over(window).cast("bigint"))
    numbered = number_rows(df, ["session_id"], ["event_time", "event_id"], "n")
    assert listed(numbered, "event_id", "n") == listed(expected, "event_id", "n")
    whole = number_rows(df, [], ["event_time", "event_id"], "n")
    assert [r.n for r in whole.orderBy("event_time", "event_id").collect()] == list(range(1, 401))


def results(spark, outcomes):
    return spark.createDataFrame([(s, o, o, ok) for s, flags in outcomes.items() for o, ok in enumerate(flags, 1)],
                                 "session_id string, event_id int, execution_order int, success boolean")


def test_replay_rollup(spark, listed):
    df = results(spark, {"a": [True] * 10, "b": [True, False, True, False, True], "c": [False]})
    assert listed(T.replay_rollup(df)) == [("a", 10, 10, 0, 0), ("b", 5, 1, 1, 3), ("c", 1, 0, 1, 0)]
    assert listed(T.replay_rollup(df, continue_on_error=True)) == [("a", 10, 10, 0, 0), ("b", 5, 3, 2, 0), ("c", 1, 0, 1, 0)]


def test_first_errors_counts_the_rest(spark, listed):
    df = results(spark, {"a": [False] * 7})
    assert listed(T.first_errors(df), "event_id", "more_errors") == [(i, 2) for i in range(1, 6)]
    assert listed(T.first_errors(results(spark, {"a": [False, True]})), "more_errors") == [(0,)]


def test_page_bounds(spark):
    df = spark.createDataFrame([("s", i) for i in range(1, 31)], "session_id string, execution_order int")
    assert [r.execution_order for r in T.page_events(df, "s", 10, 5).collect()] == [11, 12, 13, 14, 15]
    for skip, take in ((-1, 5), (0, 0), (0, 1001)):
        with pytest.raises(ValueError):
            T.page_events(df, "s", skip, take)


def test_pages_are_full_despite_gaps(spark):
    df = spark.createDataFrame([("s", i * 3, -i) for i in range(1, 31)], "session_id string, execution_order int, event_id int")
    assert [r.execution_order for r in T.page_events(df, "s", 2, 4).collect()] == [9, 12, 15, 18]
    assert [r.execution_order for r in T.page_events(df, "s", take=3, after=18).collect()] == [21, 24, 27]
    assert [r.event_id for r in T.page_events(df, "s", 1, 2, order=("event_id",)).collect()] == [-29, -28]


XML = """<RingBufferTarget truncated="0"><event name="rpc_completed" timestamp="2024-01-02T03:04:05.123456Z">
<data name="duration"><value>42</value></data><data name="logical_reads"><value>7</value></data>
<data name="statement"><value> UPDATE t SET a = 1 &lt; 2</value></data>
<action name="session_id"><value>55</value></action><action name="username"><value>sa</value></action></event>
<event name="sql_batch_completed" timestamp="bad"><data name="duration"><value>x</value></data></event></RingBufferTarget>"""


def test_shredding(spark, tmp_path):
    rows = sources.shred_trace_xml(spark.createDataFrame([(1, XML)], "buffer int, target_data string")).orderBy("event_name").collect()
    first, second = rows
    assert (first.event_name, first.duration, first.reads, first.spid, first.login_name) == ("rpc_completed", 42, 7, 55, "sa")
    assert first.statement == " UPDATE t SET a = 1 < 2" and str(first.event_time) == "2024-01-02 03:04:05.123456"
    assert first.sql_text is None and second.event_time is None and second.duration is None
    (tmp_path / "b.xml").write_text(XML)
    assert sources.read_trace_xml(spark, str(tmp_path / "b.xml")).filter("duration = 42 AND spid = 55").count() == 1


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, "DROP TABLE t"), (None, "n", None)],
                               "event_time timestamp, event_name string, sql_text string")
    got = sources.with_trace_defaults(df, F.to_timestamp(F.lit("2024-01-01"))).orderBy("event_name").collect()
    assert [(r.event_name, str(r.event_time), r.is_replayable) for r in got] == [
        ("n", "2024-01-01 00:00:00", False), ("unknown", "2024-01-01 00:00:00", True)]


def test_workload_files(spark, listed, tmp_path):
    text = "INSERT INTO cargo VALUES (1);\n  \nGO\nUPDATE t SET a = 1\r\n go \r\n;DELETE FROM t"
    df = spark.createDataFrame([(text,)], "value string")
    assert listed(sources.split_workload(df), "execution_order", "sql_text") == [
        (1, "INSERT INTO cargo VALUES (1)"), (3, "UPDATE t SET a = 1"), (5, "DELETE FROM t")]
    parity = spark.createDataFrame([("A GOB;;C",)], "value string")
    assert listed(sources.split_workload(parity, parity=True), "execution_order", "sql_text") == [(1, "A"), (2, "B"), (3, "C")]
    (tmp_path / "w.sql").write_text(text)
    assert sources.read_workload(spark, str(tmp_path)).count() == 3


def test_criteria(spark, listed):
    df = spark.createDataFrame([
        (1, "d", "app", 2000, "UPDATE dbo.t SET a = 1", "sa"), (2, "d", "app", 2000, "UPDATE sales.t SET a = 1", "bob"),
        (3, "d", "app", 10, "UPDATE dbo.t SET a = 1", None), (4, "x", "app", 2000, "SELECT * FROM sys.t", None)],
        "event_id int, database_name string, application_name string, duration bigint, sql_text string, login_name string")
    keep = lambda **c: [r[0] for r in listed(T.criteria_filter(df, c), "event_id")]
    assert keep() == [1, 2, 3, 4]
    assert keep(DatabaseName="d", MinDuration=1000) == [1, 2]
    assert keep(ExcludeUsers=["SA", "SYSTEM"]) == [2, 3, 4]
    assert keep(IncludeSchemas=["DBO", "inventory"]) == [1, 3]
    assert keep(ExcludeSystemObjects=True) == [1, 2, 3]


@pytest.mark.parametrize("seconds,listing,watch", [
    (5, "5s", "5s"), (65, "1m 5s", "1m 5s"), (3605, "1h 0m", "1h 0m 5s"), (90061, "1d 1h", "1h 1m 1s"), (0, "0s", "0s")])
def test_durations(spark, seconds, listing, watch):
    row = spark.range(1).select(X.format_duration(F.lit(seconds)).alias("a"), X.format_duration(F.lit(seconds), True).alias("b")).first()
    assert (row.a, row.b) == (listing, watch)


def test_labels(spark):
    row = spark.range(1).select(
        X.status_label(F.lit("COMPLETED"), F.lit(False)).alias("a"), X.status_label(F.lit(""), F.lit(False)).alias("b"),
        X.status_label(F.lit("odd"), F.lit(True)).alias("c"), X.is_terminal(F.lit("Cancelled")).alias("d"),
        X.is_terminal(F.lit("running")).alias("e"), X.truncate_text(F.lit("abcdefgh"), 6).alias("f"),
        X.truncate_text(F.lit(None).cast("string"), 6).alias("g"), X.lower_first(F.lit("ABC")).alias("h"),
        X.make_key(F.lit("a"), F.lit("b"), F.lit(3)).alias("i"), X.from_base64(X.to_base64(F.lit("é" * 100))).alias("j"),
        X.to_base64(F.lit("x" * 200)).alias("k")).first()
    assert row[:9] == ("✓ Completed", "✗ Failed", "odd", True, False, "abc...", "", "aBC", "a_b_3")
    assert row.j == "é" * 100 and "\n" not in row.k


def test_schema_names_may_be_bracketed_and_hold_any_character(spark, listed):
    df = spark.createDataFrame([(1, "select * from [dbo].[T]"), (2, 'delete "dbo".t'), (3, "x from dbo.t"), (4, "x from dbox.t"),
                                (5, "x from [a.b].t"), (6, "x from [aXb].t")], "event_id int, sql_text string")
    assert listed(T.criteria_filter(df, {"IncludeSchemas": ["dbo"]}), "event_id") == [(1,), (2,), (3,)]
    assert listed(T.criteria_filter(df, {"IncludeSchemas": ["a.b"]}), "event_id") == [(5,)]

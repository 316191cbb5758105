"""Queries over sessions, capture headers, workflow runs and stored comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.functions.values import micros
from driftline.operators import normalized as M
from driftline.operators import sessions as S
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.plans.diffs import _normal_pair, normal_cte
from driftline.plans.trace import EVENTS, events
from driftline.session import shared_folder
from driftline.sinks import store

catalog = Catalog()

# One session per user of the event stream.
SESSION_EXPRS = [
    "concat('s', CAST(user_id AS {text})) AS session_id", "concat('run-', CAST(user_id % 40 AS {text})) AS session_name",
    "CASE WHEN user_id % 5 = 0 THEN 'Active' WHEN user_id % 5 = 1 THEN 'Completed' WHEN user_id % 5 = 2 THEN NULL ELSE 'Stopped' END AS status",
    "user_id % 7 = 0 AS is_running", "min(ts) AS start_time", "max(ts) AS end_time",
    "concat('cfg-', CAST(count(*) AS {text})) AS configuration",
]
SESSION_SQL = f"SELECT {', '.join(e.replace('{text}', 'VARCHAR') for e in SESSION_EXPRS)} FROM events GROUP BY user_id"


def session_rows(spark, sf):
    exprs = [F.expr(e.replace("{text}", "STRING")) for e in SESSION_EXPRS]
    rows = I.table(spark, sf, "events").groupBy("user_id").agg(*exprs[4:])
    return rows.select(*exprs[:4], "start_time", "end_time", "configuration")


def stamped(df, *columns):
    return df.withColumns({c: micros(F.col(c)) for c in columns})


@catalog.add("sessions", f"SELECT session_id, session_name, status, epoch_us(start_time) AS start_time FROM ({SESSION_SQL}) s")
def sessions(spark, sf):
    rows = S.sessions(session_rows(spark, sf))
    return stamped(rows.select("session_id", "session_name", "status", "start_time"), "start_time")


@catalog.add("sessions_active", f"SELECT session_id, session_name FROM ({SESSION_SQL}) s WHERE status = 'Active' AND session_name = 'run-5'")
def sessions_active(spark, sf):
    return S.sessions(session_rows(spark, sf), name="run-5", active_only=True).select("session_id", "session_name")


@catalog.add("recent_first", f"SELECT session_id, epoch_us(start_time) AS start_time FROM ({SESSION_SQL}) s ORDER BY s.start_time DESC, session_id LIMIT 20")
def recent_first(spark, sf):
    rows = S.recent_first(session_rows(spark, sf), "start_time", "session_id", 20)
    return stamped(rows.select("session_id", "start_time"), "start_time")


EXISTING, INCOMING = "status IS NOT NULL AND status <> 'Stopped'", "status IS NULL OR status = 'Stopped'"


@catalog.add("upsert_sessions", f"""WITH s AS (SELECT * FROM ({SESSION_SQL}) x),
r AS (SELECT *, 0 AS is_new FROM s WHERE {EXISTING} UNION ALL SELECT *, 1 FROM s WHERE {INCOMING}),
p AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY is_new, start_time, session_id) AS first_rn,
  row_number() OVER (PARTITION BY session_name ORDER BY is_new DESC, start_time DESC, session_id DESC) AS last_rn FROM r)
SELECT a.session_name, a.session_id, a.status, b.configuration, epoch_us(b.start_time) AS start_time
FROM p a JOIN p b ON a.session_name = b.session_name AND a.first_rn = 1 AND b.last_rn = 1""")
def upsert_sessions(spark, sf):
    """Some sessions replace the configuration and start of others of their name.

    The result is written as the next version of the session table and read back.
    """
    rows = session_rows(spark, sf)
    path = f"{shared_folder(spark).rstrip('/')}/sessions-{uuid.uuid4().hex}"
    version = store.write_version(S.upsert_sessions(rows.filter(EXISTING), rows.filter(INCOMING)), path, 2)
    after = spark.read.parquet(version)
    return stamped(after.select("session_name", "session_id", "status", "configuration", "start_time"), "start_time")


@catalog.add("session_status", f"""SELECT s.session_id, CASE WHEN status IS NULL THEN 'Failed' WHEN is_running THEN 'Running' WHEN status = 'Active' THEN 'Stopped' ELSE status END AS state,
  epoch_us(start_time) AS started_at, coalesce(n, 0) AS event_count
FROM ({SESSION_SQL}) s LEFT JOIN (SELECT session_id, count(*) AS n FROM {EVENTS} GROUP BY session_id) c USING (session_id)""")
def session_status(spark, sf):
    return stamped(S.session_status(session_rows(spark, sf), events(spark, sf)), "started_at")


# One capture header per order, one captured table per order line.
HEADER_EXPRS = [
    "concat('h', CAST(o_orderkey AS {text})) AS capture_header_id", "concat('s', CAST(o_custkey % 200 AS {text})) AS session_id",
    "concat('cap-', CAST(o_orderkey AS {text})) AS capture_name",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Baseline' WHEN o_orderkey % 3 = 1 THEN 'Replay' ELSE 'Optimized' END AS capture_type",
    "o_orderdate AS capture_time",
]
DETAIL_EXPRS = [
    "concat('h', CAST(l_orderkey AS {text})) AS capture_header_id", "concat('t', CAST(l_linenumber AS {text})) AS table_name",
    "CAST(l_quantity AS BIGINT) AS record_count",
]
HEADER_SQL = f"SELECT {', '.join(e.replace('{text}', 'VARCHAR') for e in HEADER_EXPRS)} FROM orders"
DETAIL_SQL = f"SELECT {', '.join(e.replace('{text}', 'VARCHAR') for e in DETAIL_EXPRS)} FROM lineitem"


def headers(spark, sf):
    return I.table(spark, sf, "orders").selectExpr(*[e.replace("{text}", "STRING") for e in HEADER_EXPRS])


def details(spark, sf):
    return I.table(spark, sf, "lineitem").selectExpr(*[e.replace("{text}", "STRING") for e in DETAIL_EXPRS])


@catalog.add("captures_for_session", f"SELECT capture_header_id, epoch_us(capture_time) AS capture_time FROM ({HEADER_SQL}) h WHERE session_id = 's7' AND capture_type = 'Replay'")
def captures_for_session(spark, sf):
    rows = S.captures_for_session(headers(spark, sf), "s7", "Replay")
    return stamped(rows.select("capture_header_id", "capture_time"), "capture_time")


@catalog.add("session_captures", f"""SELECT session_name, capture_name, capture_type, epoch_us(capture_time) AS capture_time, table_name, record_count
FROM ({SESSION_SQL}) s JOIN ({HEADER_SQL}) h USING (session_id) JOIN ({DETAIL_SQL}) d USING (capture_header_id)""")
def session_captures(spark, sf):
    return stamped(S.session_captures(session_rows(spark, sf), headers(spark, sf), details(spark, sf)), "capture_time")


# One workflow per order, one step per line.
STEP_EXPRS = ["l_orderkey AS workflow_id", "l_linenumber AS step", "l_returnflag <> 'R' AS success", "l_shipdate AS start_time"]
STEP_SQL = f"SELECT {', '.join(STEP_EXPRS)}, l_shipdate + to_seconds(CAST(l_quantity * 100 AS BIGINT)) AS end_time FROM lineitem"


def steps(spark, sf):
    return I.table(spark, sf, "lineitem").selectExpr(
        *STEP_EXPRS, "timestamp_micros(unix_micros(l_shipdate) + CAST(l_quantity * 100 AS BIGINT) * 1000000) AS end_time")


REPORT_SQL = f"""SELECT workflow_id, count(*) AS step_count, count(*) FILTER (success) AS successful_steps, count(*) FILTER (NOT success) AS failed_steps,
  bool_and(success) AS success, min(start_time) AS start_time, max(end_time) AS end_time,
  (epoch_us(max(end_time)) - epoch_us(min(start_time))) // 1000000 AS duration_seconds FROM ({STEP_SQL}) s GROUP BY workflow_id"""


@catalog.add("workflow_report", f"SELECT * REPLACE (epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time) FROM ({REPORT_SQL}) r")
def workflow_report(spark, sf):
    return stamped(S.workflow_report(steps(spark, sf)), "start_time", "end_time")


def runs(spark, sf):
    status = F.when(F.col("success"), "Completed").otherwise("Failed")
    return S.workflow_report(steps(spark, sf)).withColumn("status", status)


@catalog.add("workflow_runs", f"""SELECT workflow_id, epoch_us(start_time) AS start_time, duration_seconds FROM ({REPORT_SQL}) r
WHERE NOT success AND start_time >= TIMESTAMP '1996-01-01' ORDER BY r.start_time DESC, workflow_id LIMIT 200""")
def workflow_runs(spark, sf):
    rows = S.workflow_runs(runs(spark, sf), "failed", F.to_timestamp(F.lit("1996-01-01")), 200)
    return stamped(rows.select("workflow_id", "start_time", "duration_seconds"), "start_time")


def _duration_sql(s: str) -> str:
    return f"""CASE WHEN {s} >= 86400 THEN ({s} // 86400) || 'd ' || ({s} % 86400 // 3600) || 'h'
  WHEN {s} >= 3600 THEN ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' WHEN {s} >= 60 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's' ELSE {s} || 's' END"""


@catalog.add("format_duration", f"""SELECT workflow_id, step, {_duration_sql('s')} AS list_form,
  CASE WHEN s >= 3600 THEN (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS watch_form
FROM (SELECT l_orderkey AS workflow_id, l_partkey * 100 + l_linenumber AS step, CAST(l_extendedprice AS BIGINT) * (l_partkey % 5) // (1 + 99 * (l_suppkey % 2)) AS s FROM lineitem)""")
def format_duration(spark, sf):
    """Durations from seconds to days in both forms."""
    seconds = F.floor(F.bround("l_extendedprice", 0).cast("bigint") * (F.col("l_partkey") % 5) / (1 + 99 * (F.col("l_suppkey") % 2)))
    return I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("workflow_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("step"),
        X.format_duration(seconds).alias("list_form"), X.format_duration(seconds, watch=True).alias("watch_form"))


STATES = "CASE l_linenumber WHEN 1 THEN 'completed' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'running' WHEN 5 THEN 'Pending' WHEN 6 THEN ' ' ELSE 'odd' END"


@catalog.add("status_label", f"""SELECT l_orderkey, status, CASE lower(status) WHEN 'completed' THEN '✓ Completed' WHEN 'failed' THEN '✗ Failed' WHEN 'cancelled' THEN '⊗ Cancelled'
  WHEN 'running' THEN '⟳ Running' WHEN 'pending' THEN '○ Pending' WHEN ' ' THEN CASE WHEN l_returnflag <> 'R' THEN '✓ Completed' ELSE '✗ Failed' END ELSE status END AS label,
  lower(status) IN ('completed', 'failed', 'cancelled') AS terminal, count(*) AS n
FROM (SELECT *, {STATES} AS status FROM lineitem) GROUP BY ALL""")
def status_label(spark, sf):
    rows = I.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_returnflag <> 'R' AS success", f"{STATES} AS status")
    return rows.groupBy("l_orderkey", "status", X.status_label(F.col("status"), F.col("success")).alias("label"),
                        X.is_terminal(F.col("status")).alias("terminal")).agg(F.count(F.lit(1)).alias("n"))


# One stored comparison per order.
COMPARISON_EXPRS = [
    "concat('c', CAST(o_orderkey AS {text})) AS comparison_id", "concat('s', CAST(o_custkey % 200 AS {text})) AS session_id",
    "o_orderdate AS comparison_time", "o_orderpriority AS table_name", "o_custkey % 4 AS difference_count",
]
COMPARISON_SQL = f"SELECT {', '.join(e.replace('{text}', 'VARCHAR') for e in COMPARISON_EXPRS)} FROM orders"


def comparisons(spark, sf):
    return I.table(spark, sf, "orders").selectExpr(*[e.replace("{text}", "STRING") for e in COMPARISON_EXPRS])


@catalog.add("load_comparison", f"SELECT comparison_id, epoch_us(comparison_time) AS comparison_time, difference_count FROM ({COMPARISON_SQL}) c WHERE session_id = 's12'")
def load_comparison(spark, sf):
    rows = S.load_comparison(comparisons(spark, sf), session_id="s12")
    return stamped(rows.select("comparison_id", "comparison_time", "difference_count"), "comparison_time")


@catalog.add("comparison_rollup", f"""SELECT session_id, count(*) AS tables_compared, CAST(sum(difference_count) AS BIGINT) AS total_differences,
  count(*) FILTER (difference_count > 0) AS tables_with_differences FROM ({COMPARISON_SQL}) c GROUP BY session_id""")
def comparison_rollup(spark, sf):
    return S.comparison_rollup(comparisons(spark, sf), "session_id")


@catalog.add("save_comparison", f"""WITH {normal_cte()}
SELECT t.table_name, count(DISTINCT row_key) = 0 AS is_match, count(DISTINCT row_key) AS difference_count, count(field_name) AS field_diffs
FROM (SELECT DISTINCT table_name FROM diffs) t LEFT JOIN diffs USING (table_name) GROUP BY t.table_name""")
def save_comparison(spark, sf):
    """A comparison stored and read back: summary rows beside their field differences."""
    path = f"{shared_folder(spark).rstrip('/')}/comparison-{uuid.uuid4().hex}"
    differences = M.compare_normalized(*_normal_pair(spark, sf))
    store.save_comparison(differences, path, "c1", "s1", F.to_timestamp(F.lit("2024-01-01")))
    fields = spark.read.parquet(f"{path}/field_diffs").groupBy("table_name").agg(F.count("field_name").alias("field_diffs"))
    saved = S.load_comparison(spark.read.parquet(f"{path}/comparisons"), comparison_id="c1")
    return saved.join(fields, "table_name").select("table_name", "is_match", "difference_count", "field_diffs")


@catalog.add("runtime_improvement", f"""SELECT o_orderkey AS pair_id, CAST(o_custkey - o_orderkey % 100 AS DOUBLE) AS improvement_seconds,
  CASE WHEN o_custkey <> 0 THEN round((o_custkey - o_orderkey % 100) / o_custkey * 100, 6) END AS improvement_percent FROM orders WHERE o_custkey % 3 = 0""")
def runtime_improvement(spark, sf):
    """Gain per pair where the data is identical."""
    rows = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").cast("double").alias("baseline_seconds"),
        (F.col("o_orderkey") % 100).cast("double").alias("optimized_seconds"),
        (F.col("o_custkey") % 3).alias("total_differences"))
    return S.runtime_improvement(rows).withColumn("improvement_percent", F.round("improvement_percent", 6))

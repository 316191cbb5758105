"""Trace sessions, capture headers, workflow runs and comparisons as stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import micros
from driftline.operators.trace import events_per_session


def sessions(rows: DataFrame, session_id: str | None = None, name: str | None = None,
             active_only: bool = False, newest_first: bool = True) -> DataFrame:
    """Sessions by id, by name or active only, newest first."""
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    if name is not None:
        rows = rows.filter(F.col("session_name") == name)
    if active_only:
        rows = rows.filter(F.col("status") == "Active")
    return rows.orderBy(F.desc("start_time"), "session_id") if newest_first else rows


def recent_first(rows: DataFrame, time: str, tie: str, n: int | None = None) -> DataFrame:
    ordered = rows.orderBy(F.desc(time), tie)
    return ordered if n is None else ordered.limit(n)


def upsert_sessions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert, or on the same ``session_name`` replace configuration and start time."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    image = F.struct(*[c for c in rows.columns if c not in ("session_name", "_new")])
    folded = rows.groupBy("session_name").agg(
        F.min_by(image, F.struct("_new", "start_time", "session_id")).alias("kept"),
        F.max_by(image, F.struct("_new", "start_time", "session_id")).alias("last"))
    replaced = ("configuration", "start_time")
    return folded.select("session_name", *[
        F.col("last" if c in replaced else "kept")[c].alias(c)
        for c in existing.columns if c != "session_name"]).select(*existing.columns)


def session_status(rows: DataFrame, events: DataFrame) -> DataFrame:
    """State of each session with its event count.

    Running when flagged so, Stopped when merely Active, else the stored status. A session
    without a stored status could not be looked up and is Failed.
    """
    state = (
        F.when(F.col("status").isNull(), "Failed")
        .when(F.col("is_running"), "Running")
        .when(F.col("status") == "Active", "Stopped")
        .otherwise(F.col("status"))
    )
    return rows.join(events_per_session(events), "session_id", "left").select(
        "session_id", state.alias("state"), F.col("start_time").alias("started_at"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("event_count"))


def captures_for_session(headers: DataFrame, session_id: str | None = None,
                         capture_type: str | None = None) -> DataFrame:
    """Captures of a session, all or of one type, oldest first."""
    if session_id is not None:
        headers = headers.filter(F.col("session_id") == session_id)
    if capture_type is not None:
        headers = headers.filter(F.col("capture_type") == capture_type)
    return headers.orderBy("capture_time", "capture_header_id")


def session_captures(rows: DataFrame, headers: DataFrame, details: DataFrame) -> DataFrame:
    """Sessions with their captures and the captured tables, by time."""
    joined = headers.join(rows.select("session_id", "session_name"), "session_id").join(
        details, "capture_header_id")
    return joined.select("session_name", "capture_name", "capture_type", "capture_time", "table_name",
                         "record_count").orderBy("capture_time", "capture_name", "table_name")


def workflow_report(steps: DataFrame) -> DataFrame:
    """Per workflow: steps by outcome, overall success, start, end and duration in seconds."""
    report = steps.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count_if(F.col("success")).alias("successful_steps"),
        F.count_if(~F.col("success")).alias("failed_steps"),
        F.bool_and("success").alias("success"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    return report.withColumn(
        "duration_seconds", F.floor((micros(F.col("end_time")) - micros(F.col("start_time"))) / 1_000_000))


def comparison_rollup(comparisons: DataFrame, key: str) -> DataFrame:
    """Tables compared, total differences and tables with differences per ``key``."""
    return comparisons.groupBy(key).agg(
        F.count(F.lit(1)).alias("tables_compared"),
        F.sum("difference_count").cast("bigint").alias("total_differences"),
        F.count_if(F.col("difference_count") > 0).alias("tables_with_differences"))


def workflow_runs(runs: DataFrame, status: str | None = None, since=None, limit: int = 50) -> DataFrame:
    """Newest runs, optionally of one status and since a time."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    if status is not None:
        runs = runs.filter(F.lower("status") == status.lower())
    if since is not None:
        runs = runs.filter(F.col("start_time") >= since)
    return runs.orderBy(F.desc("start_time"), "workflow_id").limit(limit)


def load_comparison(comparisons: DataFrame, comparison_id: str | None = None,
                    session_id: str | None = None) -> DataFrame:
    """One comparison, or those of a session newest first."""
    if comparison_id is not None:
        return comparisons.filter(F.col("comparison_id") == comparison_id)
    if session_id is not None:
        comparisons = comparisons.filter(F.col("session_id") == session_id)
    return comparisons.orderBy(F.desc("comparison_time"), "comparison_id")


def runtime_improvement(runs: DataFrame) -> DataFrame:
    """Seconds and percent gained per pair, only where the data is identical.

    ``runs`` holds ``pair_id, baseline_seconds, optimized_seconds, total_differences``.
    """
    gain = F.col("baseline_seconds") - F.col("optimized_seconds")
    percent = F.when(F.col("baseline_seconds") != 0, gain / F.col("baseline_seconds") * 100)
    return runs.filter("total_differences = 0").select(
        "pair_id", gain.alias("improvement_seconds"), percent.alias("improvement_percent"))


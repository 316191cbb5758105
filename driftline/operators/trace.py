"""Statement traces: filters, ordering, replay preparation, statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.statements import is_replayable, is_system, skip_statement
from driftline.functions.text import clean_sql, is_blank
from driftline.functions.values import micros
from driftline.operators.ordering import number_rows
from driftline.operators.skew import salted_left_join


def execution_order(events: DataFrame) -> DataFrame:
    """Events numbered per session by time, ties by event id."""
    return number_rows(events, ["session_id"], ["event_time", "event_id"], "execution_order")


def events_by_type(events: DataFrame, event_name: str) -> DataFrame:
    return events.filter(F.col("event_name") == event_name)


def slow_events(events: DataFrame, threshold: int = 100) -> DataFrame:
    return events.filter(F.col("duration") > threshold)


def cpu_heavy(events: DataFrame, threshold: int = 50) -> DataFrame:
    return events.filter(F.col("cpu_time") > threshold)


def io_heavy(events: DataFrame, threshold: int = 0) -> DataFrame:
    return events.filter(F.col("reads") > threshold)


def trace_capture_filter(events: DataFrame, event_names, database: str) -> DataFrame:
    """Events of the configured types in the target database."""
    return events.filter(F.col("event_name").isin(*event_names) & (F.col("database_name") == database))


def criteria_filter(events: DataFrame, criteria: dict) -> DataFrame:
    """Conjunction of the given criteria; an absent key filters nothing."""
    if criteria.get("DatabaseName"):
        events = events.filter(F.col("database_name") == criteria["DatabaseName"])
    if criteria.get("ApplicationName"):
        events = events.filter(F.col("application_name") == criteria["ApplicationName"])
    if criteria.get("MinDuration") is not None:
        events = events.filter(F.col("duration") >= criteria["MinDuration"])
    if criteria.get("ExcludeSystemObjects"):
        events = events.filter(~is_system(F.col("sql_text")))
    if criteria.get("IncludeSchemas"):
        names = "|".join(re.escape(name) for name in criteria["IncludeSchemas"])
        # The name may be bracketed or quoted.
        events = events.filter(F.col("sql_text").rlike(rf"(?i)\b({names})[\]\"]?\."))
    if criteria.get("ExcludeUsers"):
        users = [u.lower() for u in criteria["ExcludeUsers"]]
        events = events.filter(~F.coalesce(F.lower("login_name").isin(*users), F.lit(False)))
    return events


def prepare_replay(events: DataFrame, skip_select: bool = True, skip_system: bool = True,
                   exclude_patterns=(), ordered: bool = True) -> DataFrame:
    """Statements to replay: replayable, not skipped, cleaned, in execution order."""
    sql = F.col("sql_text")
    kept = events.filter(is_replayable(sql) & ~is_blank(sql)
                         & ~skip_statement(sql, skip_select, skip_system, exclude_patterns))
    statements = kept.select(
        "session_id", "event_id", clean_sql(sql).alias("sql_text"),
        F.col("event_time").alias("original_event_time"), "execution_order")
    return statements.orderBy("session_id", "execution_order") if ordered else statements


def trace_stats(events: DataFrame) -> DataFrame:
    """One row: events, replayable events, time span in microseconds, distinct names."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    # Two-level distinct: reduce to the distinct name pairs before counting them.
    reduced = events.groupBy(named("database_name").alias("db"), named("application_name").alias("app")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_replayable(F.col("sql_text"))).alias("r"),
        F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    return reduced.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_events"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("replayable_events"),
        F.coalesce(micros(F.max("last")) - micros(F.min("first")), F.lit(0)).alias("time_span_micros"),
        F.count_distinct("db").alias("databases"), F.count_distinct("app").alias("applications"))


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"))


def names_involved(events: DataFrame) -> DataFrame:
    """Distinct non-empty database and application names, one per row."""
    kinds = F.explode(F.array(
        F.struct(F.lit("database").alias("kind"), F.col("database_name").alias("name")),
        F.struct(F.lit("application").alias("kind"), F.col("application_name").alias("name"))))
    return events.select(kinds.alias("n")).select("n.kind", "n.name").filter("name <> ''").distinct()


def events_per_session(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


def frequent_statements(events: DataFrame, n: int = 10) -> DataFrame:
    counts = events.groupBy("statement").agg(F.count(F.lit(1)).alias("executions"))
    return counts.orderBy(F.desc("executions"), "statement").limit(n)


def slowest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("duration"), "event_id").limit(n)


def newest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return events.orderBy(F.desc("event_time"), F.desc("event_id")).limit(n)


def trace_event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"))


def ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy("session_id", "execution_order")


def page_events(events: DataFrame, session_id: str, skip: int = 0, take: int = 100, after: int | None = None,
                order: Sequence[str] = ("execution_order",)) -> DataFrame:
    """One page of a session's events: ``take`` rows after the first ``skip`` ones by ``order``.

    Gaps in ``execution_order`` don't shorten a page. ``after`` is the last ``execution_order`` of the
    page before: it reaches the scan, so that deep pages needn't skip over what comes before them.
    """
    if not 1 <= take <= 1000 or skip < 0:
        raise ValueError("take must be 1..1000 and skip not negative")
    page = events.filter(F.col("session_id") == session_id)
    if after is not None:
        page = page.filter(F.col("execution_order") > after)
    return page.orderBy(*order).offset(skip).limit(take)


def mark_skipped(results: DataFrame, continue_on_error: bool = False) -> DataFrame:
    """Results with ``outcome``: success, failed, or skipped after the first failure.

    The first failure per session is an aggregate joined back with salted sessions, not a
    running window, so a session holding most statements is neither sorted nor joined in
    one task.
    """
    outcome = F.when(F.col("success"), "success").otherwise("failed")
    if continue_on_error:
        return results.withColumn("outcome", outcome)
    failed = results.filter(~F.col("success")).groupBy("session_id").agg(
        F.min("execution_order").alias("_failed_at"))
    return salted_left_join(results, failed, "session_id", F.col("event_id")).withColumn(
        "outcome", F.when(F.col("execution_order") > F.col("_failed_at"), "skipped").otherwise(outcome)
    ).drop("_failed_at")


def replay_rollup(results: DataFrame, continue_on_error: bool = False) -> DataFrame:
    """Total, successful, failed and skipped statements per session."""
    marked = mark_skipped(results, continue_on_error)
    return marked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_statements"),
        F.count_if(F.col("outcome") == "success").alias("successful_statements"),
        F.count_if(F.col("outcome") == "failed").alias("failed_statements"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_statements"))


def first_errors(results: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` failed statements by order, with how many more there are."""
    failed = results.filter(~F.col("success"))
    total = failed.agg(F.count(F.lit(1)).alias("n")).scalar()
    return failed.orderBy("execution_order", "event_id").limit(n).withColumn(
        "more_errors", F.greatest(total - F.lit(n), F.lit(0)).cast("bigint"))


def session_event_pair(events: DataFrame, pair: DataFrame) -> DataFrame:
    """Event counts of a baseline and an optimized session side by side.

    ``pair`` holds ``pair_id, baseline_session, optimized_session``.
    """
    counts = events_per_session(events)
    baseline = counts.select(F.col("session_id").alias("baseline_session"), F.col("events").alias("baseline_events"))
    optimized = counts.select(F.col("session_id").alias("optimized_session"), F.col("events").alias("optimized_events"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pair.join(baseline, "baseline_session", "left").join(optimized, "optimized_session", "left").select(
        "pair_id", zero("baseline_events"), zero("optimized_events"))

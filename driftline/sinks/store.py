"""Writing captures, traces and comparisons as partitioned tables.

The capture store holds ``records`` (one JSON record per row), ``tables`` (count and
fingerprint per table) and ``headers``. The header is written last: readers join on it, so
a write that failed half-way stays invisible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import NUMBER_KINDS
from driftline.operators.normalized import difference_report
from driftline.operators.stats import capture_fingerprint, capture_totals


# Export keeps microseconds.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _json_scalar(value: Column) -> Column:
    """A value struct as JSON text of its kind."""
    bare = value["kind"].isin(*NUMBER_KINDS, "boolean", "object", "array")
    quoted = F.to_json(F.array(value["val"]))
    return F.when(value["val"].isNull(), "null").when(bare, value["val"]).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def record_json(fields: Column) -> Column:
    """A capture record as one JSON object, value kinds kept."""
    name = lambda k: F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)
    members = F.transform(F.map_entries(fields), lambda e: F.concat(
        name(e["key"]), F.lit(":"), _json_scalar(e["value"])))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def save_capture(capture: DataFrame, path: str, capture_header_id: str, capture_name: str, session_id: str,
                 capture_type: str, capture_time: Column, tables_enabled=(), tables_skipped=()) -> None:
    """Store one capture: records, then per-table counts, then the header that commits it.

    A retry takes a new header id: rows of the failed attempt keep theirs and stay invisible.
    """
    named = [F.lit(capture_header_id).alias("capture_header_id"), F.lit(capture_name).alias("capture_name")]
    # Ranges over (table, key): a large table spans many tasks and a task writes few tables.
    records = capture.select(*named, "table_name", "ordinal", "pk", "fields").repartitionByRange(
        "table_name", "pk").sortWithinPartitions("table_name", "pk")
    records.write.mode("append").partitionBy("capture_name", "table_name").parquet(f"{path}/records")
    stored = capture.sparkSession.read.parquet(f"{path}/records").filter(
        (F.col("capture_name") == capture_name) & (F.col("capture_header_id") == capture_header_id))
    capture_fingerprint(stored).select(*named, "*").write.mode("append").parquet(f"{path}/tables")
    header = capture_totals(stored).select(
        *named, F.lit(session_id).alias("session_id"), F.lit(capture_type).alias("capture_type"),
        capture_time.alias("capture_time"),
        F.array(*[F.lit(t) for t in tables_enabled]).cast("array<string>").alias("tables_enabled"),
        F.array(*[F.lit(t) for t in tables_skipped]).cast("array<string>").alias("tables_skipped"),
        "total_records", F.lit("Completed").alias("status"))
    header.write.mode("append").parquet(f"{path}/headers")


def append_trace_events(events: DataFrame, path: str, buckets: int = 64) -> None:
    """Append events, sorted by session and event within hash buckets of the session.

    A folder per session would mean millions of small files; a bucket keeps a session's
    rows together, and the range placement spreads a large session over many files.
    """
    placed = events.withColumn("session_bucket", session_bucket(F.col("session_id"), buckets)).repartitionByRange(
        "session_bucket", "session_id", "event_id").sortWithinPartitions("session_bucket", "session_id", "event_id")
    placed.write.mode("append").partitionBy("session_bucket").parquet(path)


def session_bucket(session_id: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def export_trace(events: DataFrame, path: str) -> None:
    """Nine columns of the events as JSON lines."""
    events.select("event_id", "event_time", "event_name", "database_name", "login_name", "application_name",
                  "host_name", "sql_text", "execution_order").write.mode("overwrite").json(
        path, timestampFormat=TIMESTAMP_FORMAT)


def write_profile(capture: DataFrame, path: str) -> None:
    """A capture as JSON lines ``{"table_name", "ordinal", "record"}``."""
    capture.select("table_name", "ordinal", record_json(F.col("fields")).alias("record")).write.mode(
        "overwrite").json(path)


def write_diff(diffs: DataFrame, path: str) -> None:
    diffs.write.mode("overwrite").json(path)


def save_comparison(differences: DataFrame, path: str, comparison_id: str, session_id: str,
                    comparison_time: Column, tables: DataFrame | None = None) -> None:
    """Store a comparison: field differences first, then one summary row per table.

    The summary is counted from the stored differences, so the comparison runs once.
    """
    identity = [F.lit(comparison_id).alias("comparison_id"), F.lit(session_id).alias("session_id")]
    differences.select(*identity, "*").write.mode("append").parquet(f"{path}/field_diffs")
    stored = differences.sparkSession.read.parquet(f"{path}/field_diffs").filter(
        (F.col("comparison_id") == comparison_id) & (F.col("session_id") == session_id))
    difference_report(stored, tables).select(
        *identity, comparison_time.alias("comparison_time"), "table_name",
        (F.col("total_rows") == 0).alias("is_match"), F.col("total_rows").alias("difference_count"),
    ).write.mode("append").parquet(f"{path}/comparisons")


def write_version(df: DataFrame, path: str, version: int) -> str:
    """A new version of a small table beside its predecessors."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target

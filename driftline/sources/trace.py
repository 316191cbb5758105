"""Reading statement traces and workload files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.statements import is_replayable
from driftline.functions.text import trim_blank
from driftline.sinks.store import session_bucket

# Item names in a ring-buffer document and the column each becomes (fixed values).
DATA_ITEMS = {
    "database_name": ("database_name", "string"), "duration": ("duration", "bigint"),
    "cpu_time": ("cpu_time", "bigint"), "reads": ("logical_reads", "bigint"),
    "writes": ("writes", "bigint"), "statement": ("statement", "string"),
}
ACTION_ITEMS = {
    "login_name": ("username", "string"), "application_name": ("client_app_name", "string"),
    "host_name": ("client_hostname", "string"), "spid": ("session_id", "int"),
    "sql_text": ("sql_text", "string"), "tsql_stack": ("tsql_stack", "string"),
    "plan_handle": ("plan_handle", "string"), "request_id": ("request_id", "int"),
    "client_connection_id": ("client_connection_id", "string"),
    "transaction_id": ("transaction_id", "bigint"),
}
# Statement text keeps its leading and trailing spaces.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}
_ITEM = "array<struct<_name:string,value:string>>"
_EVENT = f"struct<_name:string,_timestamp:string,data:{_ITEM},action:{_ITEM}>"


def _item(side: str, name: str, dtype: str) -> Column:
    """The first item of that name, as the wanted type."""
    value = F.try_element_at(F.filter(F.col(f"event.{side}"), lambda x: x["_name"] == name), F.lit(1))["value"]
    return value.cast("string") if dtype == "string" else value.try_cast(dtype)


def shred_trace_xml(documents: DataFrame, xml: str = "target_data") -> DataFrame:
    """Ring-buffer documents as one row per event with typed columns."""
    buffer = F.from_xml(xml, f"event array<{_EVENT}>", XML_OPTIONS)
    others = [c for c in documents.columns if c != xml]
    events = documents.select(*others, F.explode(buffer["event"]).alias("event"))
    columns = [
        F.col("event._timestamp").try_cast("timestamp").alias("event_time"),
        F.col("event._name").alias("event_name"),
        *[_item("data", source, dtype).alias(c) for c, (source, dtype) in DATA_ITEMS.items()],
        *[_item("action", source, dtype).alias(c) for c, (source, dtype) in ACTION_ITEMS.items()],
    ]
    return events.select(*others, *columns)


def read_trace_xml(spark: SparkSession, path: str) -> DataFrame:
    """Large ring-buffer files, split by event element."""
    schema = f"_name string, _timestamp string, data {_ITEM}, action {_ITEM}"
    rows = spark.read.format("xml").options(rowTag="event", **XML_OPTIONS).schema(schema).load(path)
    events = rows.select(F.struct(*rows.columns).alias("event"))
    return events.select(
        F.col("event._timestamp").try_cast("timestamp").alias("event_time"),
        F.col("event._name").alias("event_name"),
        *[_item("data", source, dtype).alias(c) for c, (source, dtype) in DATA_ITEMS.items()],
        *[_item("action", source, dtype).alias(c) for c, (source, dtype) in ACTION_ITEMS.items()])


def with_trace_defaults(events: DataFrame, ingest_time: Column) -> DataFrame:
    """Null event time reads as the ingest time, null name as ``unknown``; flags replayability."""
    return events.withColumns({
        "event_time": F.coalesce("event_time", ingest_time),
        "event_name": F.coalesce("event_name", F.lit("unknown")),
        "is_replayable": is_replayable(F.coalesce("sql_text", F.lit(""))),
    })


def split_workload(files: DataFrame, text: str = "value", parity: bool = False) -> DataFrame:
    """Workload texts as statements, numbered by position before blanks are dropped.

    Separators are ``;`` and ``GO`` alone on a line; with ``parity`` the letters ``GO``
    anywhere, empty pieces not counted.
    """
    others = [c for c in files.columns if c != text]
    if parity:
        pieces = F.filter(F.split(text, "GO|;"), lambda p: p != "")
    else:
        pieces = F.split(text, r"(?imd)^[ \t]*go[ \t]*\r?$|;")
    rows = files.select(*others, F.posexplode(pieces).alias("_pos", "_piece"))
    return rows.select(
        *others, (F.col("_pos") + 1).cast("bigint").alias("event_id"),
        (F.col("_pos") + 1).cast("bigint").alias("execution_order"),
        trim_blank(F.col("_piece")).alias("sql_text"),
    ).filter(F.col("sql_text") != "")


def read_workload(spark: SparkSession, path: str, parity: bool = False) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return split_workload(files, "value", parity)


def read_trace_events(spark: SparkSession, path: str, session_id: str | None = None, buckets: int = 64) -> DataFrame:
    """Stored trace events; one session reads its bucket alone."""
    rows = spark.read.parquet(path)
    if session_id is not None:
        bucket = session_bucket(F.lit(session_id), buckets)
        rows = rows.filter((F.col("session_bucket") == bucket) & (F.col("session_id") == session_id))
    return rows.drop("session_bucket")

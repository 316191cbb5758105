"""Reading captures: JSON documents, profile files and the capture store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.keys import pk_value
from driftline.functions.values import variant_value
from driftline.sources.documents import split_documents


# A number the variant type would round: very long, or with an exponent.
LONG_NUMBER = r"[0-9.]{30}|[0-9][eE][-+0-9]"


def exact_texts(document: Column, schema: str) -> Column:
    """The document as texts, parsed only where it holds a number a variant would round."""
    return F.when(document.rlike(LONG_NUMBER), F.from_json(document, schema))


def record_fields(record: Column, texts: Column) -> Column:
    """A JSON object variant as ``map<string, struct<kind, val>>``; ``texts`` is its map of texts or null."""
    return F.transform_values(record.cast("map<string, variant>"), lambda k, v: variant_value(v, texts[k]))


def _with_texts(records: str, texts: Column) -> Column:
    """Each record of an array beside its own texts, so exploding copies neither array."""
    return F.transform(records, lambda v, i: F.struct(v.alias("record"), texts[i].alias("texts")))


def _variants(document: str, schema: str) -> Column:
    """The document split into variants of one record each, as a variant holds at most 128 MiB; null if it is bad."""
    return F.from_json(document, schema, {"allowSingleQuotes": "false"})


def _all_objects(records) -> Column:
    return ~F.exists(records, lambda v: ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def parse_table_documents(details: DataFrame, document: str = "capture_data",
                          part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents ``[record, ...]`` per ``table_name`` as (records, rejected documents).

    ``part`` names an integer column when one table is stored as several documents. A
    document that is not a JSON array of objects is rejected, the rest is read.
    """
    records = F.when(F.col(document).rlike(r"^\s*\["), _variants(document, "array<variant>"))
    texts = exact_texts(F.col(document), "array<map<string, string>>")
    parsed = details.withColumn("_records", records).withColumn("_texts", texts).withColumn(
        "_good", F.coalesce(F.col("_records").isNotNull() & _all_objects("_records"), F.lit(False)))
    rejects = parsed.filter(~F.col("_good")).drop("_records", "_texts", "_good")
    others = [c for c in details.columns if c != document]
    rows = parsed.filter("_good").select(*others, F.posexplode(_with_texts("_records", F.col("_texts"))).alias("_pos", "_item"))
    ordinal = F.col("_pos").cast("bigint")
    if part is not None:
        # Documents of one table follow each other in part order.
        ordinal = F.col(part).cast("bigint") * F.lit(2**31) + ordinal
    fields = record_fields(F.col("_item.record"), F.col("_item.texts"))
    rows = rows.select(*others, ordinal.alias("ordinal"), fields.alias("fields"))
    return rows.withColumn("pk", pk_value(F.col("fields"))), rejects


def parse_captures(documents: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Documents ``{table: [record, ...], ...}`` as (capture records, rejected documents).

    A document is rejected unless it is an object of arrays of objects, each table once.
    """
    parsed = documents.withColumn("_tables", _variants(document, "map<string, array<variant>>")).withColumn(
        "_good", _good_tables("_tables"))
    return _capture_rows(parsed.filter("_good").drop("_good"), document), parsed.filter(~F.col("_good")).drop("_tables", "_good")


def parse_capture_json(documents: DataFrame, document: str) -> DataFrame:
    """Records as of ``parse_captures``; a document it would reject is an error, a null one has no records."""
    parsed = documents.withColumn("_tables", _variants(document, "map<string, array<variant>>"))
    bad = F.raise_error(F.concat(F.lit("not a capture document: "), F.substring(document, 1, 100)))
    tables = F.when(_good_tables("_tables"), F.col("_tables")).when(F.col(document).isNotNull(), bad)
    return _capture_rows(parsed.withColumn("_tables", tables), document)


def _good_tables(tables: str) -> Column:
    keys = F.map_keys(tables)
    return F.coalesce((F.size(F.array_distinct(keys)) == F.size(keys)) & ~F.exists(
        F.map_values(tables), lambda records: records.isNotNull() & ~_all_objects(records)), F.lit(False))


def _capture_rows(parsed: DataFrame, document: str) -> DataFrame:
    others = [c for c in parsed.columns if c not in (document, "_tables")]
    texts = exact_texts(F.col(document), "map<string, array<map<string, string>>>").alias("_texts")
    by_table = parsed.select(*others, texts, F.explode("_tables").alias("table_name", "_records"))
    items = _with_texts("_records", F.try_element_at("_texts", "table_name"))
    rows = by_table.select(*others, "table_name", F.posexplode(items).alias("_pos", "_item"))
    return rows.select(
        *others, "table_name", F.col("_pos").cast("bigint").alias("ordinal"),
        record_fields(F.col("_item.record"), F.col("_item.texts")).alias("fields")).withColumn(
        "pk", pk_value(F.col("fields")))


def capture_details(headers: DataFrame, details: DataFrame, capture_name: str | None = None) -> DataFrame:
    """Capture headers joined with their detail documents."""
    if capture_name is not None:
        headers = headers.filter(F.col("capture_name") == capture_name)
    return headers.join(details, "capture_header_id")


def load_capture(headers: DataFrame, details: DataFrame, capture_name: str, session_id: str | None = None,
                 part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One capture as (records, rejected documents).

    The name resolves within a session. An unknown or ambiguous name is an error. ``part``
    names the column that orders the documents of a table stored as several.
    """
    if session_id is not None:
        headers = headers.filter(F.col("session_id") == session_id)
    found = headers.filter(F.col("capture_name") == capture_name).limit(2).count()
    if found == 0:
        raise LookupError(f"capture {capture_name!r} not found")
    if found > 1:
        raise ValueError(f"capture name {capture_name!r} is ambiguous; name its session")
    chosen = capture_details(headers.select("capture_header_id", "capture_name"), details, capture_name)
    columns = ["table_name", "capture_data"] if part is None else ["table_name", part, "capture_data"]
    records, rejects = parse_table_documents(chosen.select(*columns), part=part)
    return records.select("table_name", "ordinal", "pk", "fields"), rejects


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile files, each one ``{table: [record, ...]}`` document of any size, as capture records.

    A file is read by as many tasks as it has ranges; a bad document is an error.
    """
    rows = split_documents(spark, path)
    bad = F.raise_error(F.concat(F.lit("not a record: "), F.substring("record", 1, 100))).cast("variant")
    record = F.coalesce(F.try_parse_json("record"), F.when(F.col("record").isNotNull(), bad))
    fields = record_fields(record, exact_texts(F.col("record"), "map<string, string>"))
    return rows.select("table_name", "ordinal", fields.alias("fields")).withColumn(
        "pk", pk_value(F.col("fields"))).select("table_name", "ordinal", "pk", "fields")


def read_profile_lines(spark: SparkSession, path: str) -> DataFrame:
    """Profiles written one record per line as ``{"table_name", "ordinal", "record"}``.

    Lines split freely, so this is the form for large profiles.
    """
    lines = spark.read.schema("table_name string, ordinal bigint, record string").json(path)
    fields = record_fields(F.try_parse_json("record"), exact_texts(F.col("record"), "map<string, string>"))
    return lines.select("table_name", "ordinal", fields.alias("fields")).withColumn(
        "pk", pk_value(F.col("fields"))).select("table_name", "ordinal", "pk", "fields")


def read_store(spark: SparkSession, path: str, capture_name: str) -> DataFrame:
    """A stored capture; rows without a committed header are invisible."""
    headers = spark.read.parquet(f"{path}/headers").filter(F.col("capture_name") == capture_name)
    records = spark.read.parquet(f"{path}/records").filter(F.col("capture_name") == capture_name)
    return records.join(headers.select("capture_name", "capture_header_id").distinct(),
                        ["capture_name", "capture_header_id"], "left_semi").select(
        "table_name", "ordinal", "pk", "fields")

"""Queries over whole texts and names: digests, labels, text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import keys as K
from driftline.functions import text as X
from driftline.functions import values as V
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog

catalog = Catalog()


def documents(spark, sf):
    return I.table(spark, sf, "documents")


@catalog.add("sha256", "SELECT doc_id, sha256(text) AS hex, to_base64(unhex(sha256(text))) AS b64 FROM documents")
def sha256(spark, sf):
    return documents(spark, sf).select("doc_id", K.sha256_hex(F.col("text")).alias("hex"),
                                       K.sha256_base64(F.col("text")).alias("b64"))


@catalog.add("base64_round_trip", "SELECT doc_id, to_base64(encode(text)) AS b64, TRUE AS same FROM documents")
def base64_round_trip(spark, sf):
    encoded = X.to_base64(F.col("text"))
    return documents(spark, sf).select("doc_id", encoded.alias("b64"), (X.from_base64(encoded) == F.col("text")).alias("same"))


@catalog.add("truncate_text", """SELECT doc_id, CASE WHEN length(text) = 0 THEN '' WHEN length(text) <= 600 THEN text ELSE text[1:597] || '...' END AS short,
  rpad(text[1:30], 30, ' ') AS padded_right, CASE WHEN length(source) > 12 THEN source[1:12] ELSE lpad(source, 12, ' ') END AS padded_left FROM documents""")
def truncate_text(spark, sf):
    return documents(spark, sf).select(
        "doc_id", X.truncate_text(F.col("text"), 600).alias("short"),
        X.pad_or_truncate_right(F.col("text"), 30).alias("padded_right"),
        X.pad_or_truncate_left(F.col("source"), 12).alias("padded_left"))


@catalog.add("strip_ws_lower", "SELECT doc_id, lower(regexp_replace(text, '[ \\r\\n\\t]', '', 'g')) AS stripped FROM documents")
def strip_ws_lower(spark, sf):
    return documents(spark, sf).select("doc_id", X.strip_ws_lower(F.col("text")).alias("stripped"))


@catalog.add("text_helpers", """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END, p_type) AS preferred,
  lower(p_brand[1]) || p_brand[2:] AS lowered, p_name || '_' || p_brand AS key2, p_name || '_' || p_brand || '_' || p_size AS key3,
  lower(p_name) = 'small ring' AS eq, contains(lower(p_name), 'ring') AS has, starts_with(lower(p_type), 'eco') AS starts,
  ends_with(lower(p_brand), '7') AS ends FROM part""")
def text_helpers(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return I.table(spark, sf, "part").select(
        "p_partkey", X.default_text(F.when(F.col("p_partkey") % 4 != 0, name), kind).alias("preferred"),
        X.lower_first(brand).alias("lowered"), X.make_key(name, brand).alias("key2"),
        X.make_key(name, brand, F.col("p_size")).alias("key3"),
        X.equals_ignore_case(name, F.lit("SMALL Ring")).alias("eq"),
        X.contains_ignore_case(name, F.lit("RING")).alias("has"),
        X.starts_with_ignore_case(kind, F.lit("Eco")).alias("starts"),
        X.ends_with_ignore_case(brand, F.lit("7")).alias("ends"))


@catalog.add("wildcard_match", """SELECT p_partkey, regexp_full_match(lower(p_name), 's.*ring') AS star, regexp_full_match(lower(p_brand), 'brand#.') AS mark,
  regexp_full_match(lower(p_type), '.*nom.*') AS percent FROM part""")
def wildcard_match(spark, sf):
    return I.table(spark, sf, "part").select(
        "p_partkey", X.wildcard_match(F.col("p_name"), "S*RING").alias("star"),
        X.wildcard_match(F.col("p_brand"), "brand#?").alias("mark"),
        X.like_match(F.col("p_type"), "%nom%").alias("percent"))


@catalog.add("null_defaults", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS number, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END AS amount,
  epoch_us(CASE WHEN event_id % 5 = 0 THEN ts ELSE TIMESTAMP '0001-01-01' END) AS stamp, CASE WHEN event_id % 7 = 0 THEN event_type END AS name,
  event_id % 11 = 0 AS flag, CASE WHEN event_id % 13 = 0 THEN event_type ELSE '00000000-0000-0000-0000-000000000000' END AS guid FROM events""")
def null_defaults(spark, sf):
    when = lambda n, c: F.when(F.col("event_id") % n == 0, c)
    rows = I.table(spark, sf, "events").select(
        "event_id", when(2, F.col("user_id")).alias("number"), when(3, F.col("value")).alias("amount"),
        when(5, F.col("ts")).alias("stamp"), when(7, F.col("event_type")).alias("name"),
        when(11, F.lit(True)).alias("flag"), when(13, F.col("event_type")).alias("guid"))
    return V.null_defaults(rows, guid_columns=("guid",)).withColumn("stamp", V.micros(F.col("stamp")))


@catalog.add("read_utc", "SELECT event_id, epoch_us(ts) AS instant FROM events")
def read_utc(spark, sf):
    """Times of the event file, declared UTC, as instants."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select("event_id", V.micros(V.read_utc(F.col("ts"))).alias("instant"))

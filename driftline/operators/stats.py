"""Counts, totals and fingerprints of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.keys import sha256_hex
from driftline.model import OPERATION_FIELD


def capture_totals(capture: DataFrame) -> DataFrame:
    """One row: tables with changes and total records."""
    per_table = capture.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    return per_table.agg(F.count(F.lit(1)).alias("tables_with_changes"),
                         F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_records"))


def profile_stats(capture: DataFrame) -> DataFrame:
    """Records per table and operation."""
    return capture.groupBy("table_name", F.col("fields")[OPERATION_FIELD]["val"].alias("operation")).agg(
        F.count(F.lit(1)).alias("records"))


def _sized(value: Column) -> Column:
    """Text behind its length, so that what is joined can be told apart; null is ``~``."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~"))


def capture_fingerprint(capture: DataFrame, ignore=()) -> DataFrame:
    """Order-free fingerprint per table: rows, and sums and a xor of row digests.

    A row's digest is the SHA-256 of its key and of its fields' names, kinds and values; a null has no
    kind. ``digest_sum`` holds four sums, each of 15 hex digits of the digests, ``digest_xor`` is of the
    first 15. Nothing is collected.
    """
    fields = F.map_filter("fields", lambda k, _: ~k.isin(*ignore)) if ignore else F.col("fields")
    names = F.array_sort(F.map_keys(fields))
    text = F.array_join(F.transform(names, lambda n: F.concat(_sized(n), F.when(
        fields[n]["val"].isNull(), F.lit("~")).otherwise(F.concat(_sized(fields[n]["kind"]), _sized(fields[n]["val"]))))), "")
    digest = sha256_hex(F.concat(_sized(F.col("pk").cast("string")), text))
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("bigint").alias(f"d{k}") for k in range(4)]
    sums = [F.sum(F.col(f"d{k}").cast("decimal(38,0)")).cast("decimal(38,0)").cast("string") for k in range(4)]
    return capture.select("table_name", digest.alias("h")).select("table_name", *parts).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.concat_ws(":", *sums).alias("digest_sum"), F.bit_xor("d0").alias("digest_xor"))


def tables_with_diffs(diffs: DataFrame, key: str = "key") -> DataFrame:
    """Differing rows per table; tables without any are absent."""
    return diffs.select("table_name", key).distinct().groupBy("table_name").agg(
        F.count(F.lit(1)).alias("differences"))


def union_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).union(right.select(*keys)).distinct()


def except_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Table names on the left only; names are reduced per side before they meet."""
    names = lambda df: df.select("table_name").distinct()
    return names(left).join(names(right), "table_name", "left_anti")


def intersect_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    names = lambda df: df.select("table_name").distinct()
    return names(left).join(names(right), "table_name", "left_semi")

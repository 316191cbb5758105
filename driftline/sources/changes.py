"""Reading change rows: whole tables, LSN ranges, time ranges, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_changes(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of several change tables as one table with ``table_name``; empty ones vanish."""
    union = None
    for name, df in tables.items():
        rows = df.withColumn("table_name", F.lit(name))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    if union is None:
        raise ValueError("no change tables given")
    return union


def scan_parquet(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return scan_changes({name: spark.read.parquet(path) for name, path in paths.items()})


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              partitions: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A change table over JDBC, read in parallel key ranges."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def scan_all_changes(changes: DataFrame, min_lsn: Column, max_lsn: Column) -> DataFrame:
    """Changes within an inclusive LSN range, both update images included."""
    return changes.filter(F.col("start_lsn").between(min_lsn, max_lsn))


def scan_changes_after(changes: DataFrame, min_lsn: Column, ordered: bool = False) -> DataFrame:
    """Changes strictly after an LSN, on request in ``(start_lsn, seqval)`` order."""
    rows = changes.filter(F.col("start_lsn") > min_lsn)
    return rows.orderBy("start_lsn", "seqval", "op") if ordered else rows


def lsn_range_for_time(lsn_time: DataFrame, from_time: Column, to_time: Column) -> DataFrame:
    """One row: smallest LSN at or after ``from_time``, largest at or before ``to_time``."""
    return lsn_time.agg(
        F.min(F.when(F.col("change_time") >= from_time, F.col("start_lsn"))).alias("from_lsn"),
        F.max(F.when(F.col("change_time") <= to_time, F.col("start_lsn"))).alias("to_lsn"))


def changes_in_time(changes: DataFrame, lsn_time: DataFrame, from_time: Column, to_time: Column) -> DataFrame:
    """Changes of a time window; the two bounds are scalar subqueries, not a join."""
    bounds = lsn_range_for_time(lsn_time, from_time, to_time)
    return scan_all_changes(changes, bounds.select("from_lsn").scalar(), bounds.select("to_lsn").scalar())


def lsn_watermarks(changes: DataFrame) -> DataFrame:
    """Rows, smallest and largest LSN per table."""
    return changes.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("start_lsn").alias("min_lsn"),
        F.max("start_lsn").alias("max_lsn"))


def recent_changes(changes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most recent changes."""
    return changes.orderBy(F.desc("start_lsn"), F.desc("seqval"), F.desc("op")).limit(n)

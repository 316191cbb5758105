"""Numbering rows in order without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialize


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Like ``row_number()`` per group, safe when one group holds most rows.

    A window would sort a whole group in one task. Here rows are range-partitioned on
    group and order together, so a large group spans many partitions; the sorted rows are
    written once, and the per-partition counts of each group (a small table) give the
    offset of every partition. ``order`` must identify a row within its group.
    """
    keys = [*group, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = materialize(placed, f"numbered-{name}")
    parts = placed.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_part").alias("_g_part"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    match = F.col("_part") == F.col("_g_part")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(offsets, match).select(
        *df.columns, (F.col("_pos") + F.col("_shift") + 1).cast("bigint").alias(name))

"""Joins that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is split where it holds more than one part in so many of all rows, and more rows than a task minds.
PARTS, FEW_ROWS = 2000, 100_000


def salted_left_join(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, parts: int = PARTS,
                     few: int = FEW_ROWS) -> DataFrame:
    """Left join of many rows per key with at most one lookup row per key.

    Keys are counted first. One with more than ``n = max(all rows / parts, few)`` rows is
    spread over as many groups as it has ``n`` rows, by ``spread``, and its lookup row is
    repeated for each; the other keys stay as they are, and the result is exact. At most
    ``parts`` keys are that frequent, so they are broadcast. Use it where the next step
    groups by the same key: the adaptive skew join steps back there, because its split would
    need another shuffle.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.greatest(F.ceil(F.sum("_n") / parts), F.lit(few))).scalar()
    frequent = F.broadcast(counts.where(F.col("_n") > most).select("_key", F.ceil(F.col("_n") / most).cast("int").alias("_salts")))
    salts = lambda df: df.join(frequent, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(
        "_salts", F.coalesce("_salts", F.lit(1)))
    salted = salts(rows).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int")).drop("_salts")
    repeated = salts(lookup).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")

"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the text digests find the digests that may be frequent; a second
pass counts those exactly. The verified ones, at most ``counters``, are broadcast and settle
their rows without a shuffle; all others are too rare to be hot and take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftline.session import materialize

#: Counters of each summary. A digest with more than rows / (COUNTERS + 1) rows is always found.
COUNTERS = 1024


def normalized(text: F.Column) -> F.Column:
    """``text`` with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _reduced(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """A Misra-Gries summary cut back to ``counters`` entries by one common subtraction."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def _summarize(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for entry in batch.column(0).value_counts().to_pylist():
                held[entry["values"]] = held.get(entry["values"], 0) + entry["counts"]
            held = _reduced(held, counters)
        digests = [None, *held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array([rows, *held.values()], pa.int64())], ["digest", "weight"])

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> tuple[list[bytes], int]:
    """Digests that may have more than rows / (counters + 1) rows, at most ``counters``; and the rows.

    Every task returns one summary; summed and cut once more they are the summary of the whole.
    """
    summed = (digests.select("digest").mapInArrow(_summarize(counters), "digest binary, weight bigint")
              .groupBy("digest").agg(F.sum("weight").alias("weight")))
    rows = summed.where("digest IS NULL").agg(F.coalesce(F.max("weight"), F.lit(0))).first()[0]
    top = summed.where("digest IS NOT NULL").orderBy(F.desc("weight")).limit(counters + 1).collect()
    found = _reduced({bytes(r["digest"]): r["weight"] for r in top}, counters)
    return list(found), rows


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalized forms are. Null text counts as empty. ``keep_id`` is
    the smallest id of the group (null only where all its ids are null); rows that repeat an id
    together with its text are one document and share the decision. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest")), "digests")

    candidates, rows = frequent_digests(marked, counters)
    schema = T.StructType([T.StructField("digest", T.BinaryType())])
    listed = spark.createDataFrame([(d,) for d in candidates], schema)
    exact = (marked.join(F.broadcast(listed), "digest").groupBy("digest")
             .agg(F.min("doc_id").alias("hot_id"), F.count(F.lit(1)).alias("hot_size"))
             .where(F.col("hot_size") * (counters + 1) > rows).collect())
    winners = spark.createDataFrame(
        [tuple(r) for r in exact],
        T.StructType([schema["digest"], T.StructField("hot_id", marked.schema["doc_id"].dataType),
                      T.StructField("hot_size", T.LongType())]))

    told = marked.join(F.broadcast(winners), "digest", "left")
    hot = told.where("hot_size IS NOT NULL").select(
        "doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "digest")
    group = Window.partitionBy("digest")
    rest = told.where("hot_size IS NULL").select(
        "doc_id", F.min("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"), "digest")
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Ids should be unique."""
    kept = duplicate_groups(docs, id_col, text_col, counters).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")

"""The training corpus pipeline: documents that pass every stage, encoded.

Each stage reads what the one before kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.bpe import encode_texts
from driftline.llm.decontaminate import find_benchmark
from driftline.llm.exact_dedup import drop_duplicates
from driftline.llm.near_dedup import drop_near_duplicates
from driftline.llm.toxicity import score_toxicity
from driftline.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = score_toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__toxic"))
    return docs.join(toxic, docs["doc_id"].eqNullSafe(toxic["__toxic"]), "left_anti").select(COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one with the smallest id stays."""
    return drop_duplicates(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the smallest id stays."""
    return drop_near_duplicates(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document of which nothing is left goes.

    Clean documents stay as they are. The parts around a passage are joined by a line feed.
    """
    found = find_benchmark(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("spans") > 0).select("doc_id", "text", "spans")
    body = F.encode("text", "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end_byte"]))
    starts = F.concat(F.transform("spans", lambda s: s["start_byte"]), F.array(F.octet_length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("from"), starts.alias("to")), lambda p: F.trim(F.decode(
        F.substring(body, p["from"].cast("int") + 1, (p["to"] - p["from"]).cast("int")), "UTF-8")))
    cut = hit.select(F.col("doc_id").alias("__hit"), F.array_join(F.filter(parts, lambda p: p != ""), "\n").alias("__left"))
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["__hit"]), "left")
    text = F.when(F.col("__left").isNull(), F.col("text")).otherwise(F.col("__left"))
    return joined.where("__left IS NULL OR __left <> ''").select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(F.col("__left").isNull(), F.col("n_chars")).otherwise(F.length("__left").cast("long")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hashes of the ids and of what they decode to."""
    return encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL expresses neither the language models nor the merges; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs

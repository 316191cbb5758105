"""The registered queries of the text operators, and the SQL they equal where SQL can say it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.alignment import align_tokenizers
from driftline.llm.bpe import encode_texts
from driftline.llm.chat import render_perspectives
from driftline.llm.decontaminate import contamination
from driftline.llm.exact_dedup import duplicate_groups
from driftline.llm.html_text import extract_pages
from driftline.llm.licenses import scan_licenses
from driftline.llm.near_dedup import near_duplicates
from driftline.llm.quality import score_quality
from driftline.llm.spelling import spelling_groups
from driftline.llm.suffix_dedup import remove_repeats
from driftline.llm.token_counts import count_tokens
from driftline.llm.toxicity import score_toxicity
from driftline.plans.catalog import Catalog

catalog = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@catalog.add("op2_exact_dedup", sql=r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


@catalog.add("op3_chat_formatting")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_perspectives(table(spark, sf_dir, "conversations"))


@catalog.add("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@catalog.add("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@catalog.add("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@catalog.add("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@catalog.add("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                        public_tokenizers.PATTERN, keep_ids=False)


@catalog.add("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@catalog.add("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@catalog.add("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@catalog.add("op11_quality")
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@catalog.add("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


@catalog.add("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_tokenizers(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)

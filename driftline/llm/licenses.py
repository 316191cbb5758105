"""License scans: known phrases by place, and license templates by an exact set-similarity join.

Everything is column expressions. A first pass keeps, of each text, its word count and the
words that occur in any phrase or template with their places (a small array). Their counts over
all texts give the global order, rarest first. A text block can only hold the wanted share of a
template if it has one of the template's first few tokens in that order, so only those tokens
probe; length and position filters follow, and the full overlap decides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

#: Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: License templates and their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "confidential and proprietary unauthorized copying of this file via any medium is strictly prohibited",
}

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9

#: Words of a block, and between block starts: a passage of up to BLOCK - STEP words is whole in one.
BLOCK, STEP = 64, 32

_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _needed(words: list[str], share: float) -> int:
    return max(1, math.ceil(share * len(words) - 1e-9))


def _listed(words: list[str]) -> str:
    """``words`` as the inside of an SQL list. They hold letters and digits only."""
    return ", ".join(f"'{w}'" for w in words)


def word_hits(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, hits``: the words of ``vocabulary`` in each text as ``(at, word)``, in order.

    The split runs on the text as it is; only the words that can matter are lower-cased, A-Z alone.
    """
    split = docs.select(F.col(id_col).alias("doc_id"),
                        F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _SPLIT).alias("words"))
    # A text that starts or ends with other characters has one empty word there.
    split = split.withColumn("lead", F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)) \
        .withColumn("tail", F.when((F.size("words") > 1) & (F.get("words", F.size("words") - 1) == ""), 1).otherwise(0))
    folded = f"translate(w, '{_ASCII_UPPER}', '{_ASCII_LOWER}')"
    return split.select(
        "doc_id", (F.size("words") - F.col("lead") - F.col("tail")).cast("long").alias("n_words"),
        F.expr(f"""filter(transform(words, (w, i) -> CASE WHEN lower(w) IN ({_listed(vocabulary)})
                   THEN struct(i - lead AS at, {folded} AS word) END),
                   h -> h IS NOT NULL AND h.word IN ({_listed(vocabulary)}))""").alias("hits"))


def _phrase_places(phrase: str) -> F.Column:
    """Places (of the first word) where the words of ``phrase`` stand consecutively."""
    words = phrase.split(" ")
    following = "".join(f" AND coalesce(get(hits, k + {j}).word = '{w}' AND get(hits, k + {j}).at = h.at + {j}, false)"
                        for j, w in enumerate(words[1:], 1))
    return F.expr(f"transform(filter(hits, (h, k) -> h.word = '{words[0]}'{following}), h -> h.at)")


def _template_score(tokens: list[str], share: float) -> F.Column:
    """Largest share of the template in any block that reaches ``share``, else 0. ``tokens``: rarest first.

    Block b holds the words b * STEP .. b * STEP + BLOCK - 1. Length filter: its words can't be fewer
    than needed. Position filter: from the first prefix token that it has, the template must have
    enough tokens left.
    """
    need = _needed(tokens, share)
    prefix = tokens[: len(tokens) - need + 1]
    inside = f"h.at >= b * {STEP} AND h.at < b * {STEP} + {BLOCK}"
    left = f"map({', '.join(f"'{t}', {len(tokens) - i}" for i, t in enumerate(prefix))})"
    blocks = f"""array_distinct(flatten(transform(filter(hits, h -> h.word IN ({_listed(prefix)})),
        h -> sequence(greatest(0, h.at div {STEP} - {BLOCK // STEP - 1}), h.at div {STEP}))))"""
    reach = f"array_max(transform(filter(hits, h -> {inside}), h -> {left}[h.word]))"
    overlap = f"""size(array_distinct(transform(filter(hits, h -> {inside} AND h.word IN ({_listed(tokens)})),
        h -> h.word)))"""
    best = f"""coalesce(array_max(transform(filter({blocks}, b -> least(n_words - b * {STEP}, {BLOCK}) >= {need}
        AND {reach} >= {need}), b -> {overlap})), 0)"""
    return F.expr(f"array_max(transform(array({best}), n -> IF(n >= {need}, n / {len(tokens)}D, 0D)))")


def global_order(hits: DataFrame, tokens: list[str]) -> list[str]:
    """``tokens`` by their count over all texts, rarest first, then by name."""
    counted = (hits.select(F.explode("hits.word").alias("word")).where(F.col("word").isin(tokens))
               .groupBy("word").count().collect())  # at most as many rows as the templates have words
    counts = {r["word"]: r["count"] for r in counted}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                  share: float = CONTAINMENT) -> DataFrame:
    """One row per text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of all phrases; ``first_word`` and ``last_word`` are the smallest and
    largest word number at which one starts, null without any. ``score`` is 1 where a phrase stands,
    else the largest share of a template among the blocks that reach ``share``, else 0. Null and empty
    texts have no words, no labels and score 0; repeated rows give repeated rows; other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = {k: sorted(set(v.split(" "))) for k, v in (TEMPLATES if templates is None else templates).items()}
    vocabulary = sorted({w for p in phrases for w in p.split(" ")} | {w for v in templates.values() for w in v})
    hits = materialize(word_hits(docs, vocabulary, id_col, text_col), "license-words")
    order = global_order(hits, sorted({w for v in templates.values() for w in v}))
    rank = {w: i for i, w in enumerate(order)}

    placed = hits.select("*", *[_phrase_places(p).alias(f"p{i}") for i, p in enumerate(phrases)],
                         *[_template_score(sorted(v, key=rank.get), share).alias(f"t{i}")
                           for i, v in enumerate(templates.values())])
    found = placed.select(
        "*", F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))])).alias("places"),
        F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label))
                                  for i, label in enumerate(phrases.values())])).alias("base"),
        F.array_compact(F.array(*[F.when(F.col(f"t{i}") > 0, F.lit(label))
                                  for i, label in enumerate(templates)])).alias("more"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "more")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), *[F.col(f"t{i}") for i in range(len(templates))])).alias("score"))

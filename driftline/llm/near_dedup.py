"""Near duplicates by bottom-k sketches from one hash function.

A text's set is its distinct word shingles; its sketch is the SKETCH smallest hashes. Texts of equal
sets are one class, and all further work is on classes. Inverted lists of retained values propose
pairs, the sketch of the union estimates their similarity, and the full sets decide.

No list is paired out without bound. Linked classes share most retained values, so a class needs
only its rarest few as keys (the prefix principle, rarest value first): a passage that many texts
share drops out. Short lists give their pairs; in a long one, as a large group of near copies has,
each class meets the list's least class, then the least one outside that component. Classes of lists
that still hold several components go through a prefix join on their full sets, which is exact: an edit
makes shingles that no other class has, these come first in the order of frequency, and a class with
too many of them has nothing left to be looked up by.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.arrow import LOWER, mixed, span_hashes, text_chunks, word_spans
from driftline.llm.components import connected_components
from driftline.session import materialize

#: Retained values of a sketch.
SKETCH = 64

#: Classes of a list that is paired out at once, and pivots of a longer one before the rest is.
SHORT_LIST, PIVOTS = 24, 2

#: Odds that a linked pair has fewer retained values in common than `_common` says.
MISSED = 1e-8

#: Sets up to this size are whole in their sketch, and so is any set linked with them.
WHOLE = 51


def _common(percent: int) -> int:
    """A pair of that similarity has fewer of SKETCH values in common with odds of MISSED at most."""
    odds, total = percent / 100, 0.0
    for count in range(SKETCH + 1):
        total += comb(SKETCH, count) * odds**count * (1 - odds) ** (SKETCH - count)
        if total > MISSED:
            return count
    return SKETCH


_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def _sets(body: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, row after row, and the number of each row's."""
    body = LOWER[body]
    starts, ends, rows = word_spans(body, at, _IS_WORD)
    words = span_hashes(body, starts, ends)
    n_rows = len(at) - 1
    n_words = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(n_words)])
    # A row of fewer words has one shingle, all of them.
    shingles = np.zeros(len(words), np.uint64)
    for k in range(width):
        size = len(words) - k
        if size > 0:
            inside = rows[:size] == rows[k:]
            term = mixed(words[k:] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            shingles[:size] = np.where(inside, (shingles[:size] ^ term) * np.uint64(0xC2B2AE3D27D4EB4F), shingles[:size])
    place = np.arange(len(words)) - first[rows]
    kept = place <= np.maximum(n_words[rows] - width, 0)
    # Signed order from here on, as Spark has it.
    values, owner = mixed(shingles[kept]).view(np.int64), rows[kept]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=n_rows)


def _digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each row's set, from two sums of its values' hashes."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    parts = []
    for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values.view(np.uint64) ^ np.uint64(salt)))])
        parts.append(mixed(total[edges[1:]] - total[edges[:-1]] + sizes.astype(np.uint64)))
    return [row.tobytes() for row in np.stack(parts, 1)]


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int64()))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, body, at in text_chunks(batch.column(1)):
                values, sizes = _sets(body, at, width)
                short = np.minimum(sizes, SKETCH)
                goes = np.concatenate([[0], np.cumsum(short)])
                source = np.arange(goes[-1]) + np.repeat(np.cumsum(sizes) - sizes - goes[:-1], short)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()),
                     pa.array(_digests(values, sizes), pa.binary()), _lists(values[source], goes)],
                    ["doc_id", "n", "cls", "sketch"])

    return run


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0)
            for first, last, body, at in text_chunks(batch.column(1)):
                values, sizes = _sets(body, at, width)
                same = np.array([a == b for a, b in zip(_digests(values, sizes), wanted.slice(first, last - first).to_pylist(),
                                                       strict=True)], bool)
                yield pa.RecordBatch.from_arrays(
                    [wanted.slice(first, last - first), _lists(values, np.concatenate([[0], np.cumsum(sizes)]))],
                    ["cls", "shingles"]).filter(pa.array(same))

    return run


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs with their components so far, those within one left out."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    return pairs.where("label_a <> label_b")


class _Links:
    """Verified links, and the components they make."""

    def __init__(self, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> None:
        self.classes, self.texts, self.width, self.percent = classes, texts, width, percent
        self.full: DataFrame | None = None
        self.labels: DataFrame | None = None

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """``a, b, est`` of the distinct pairs that their lengths and the sketch of their union leave."""
        for end in ("a", "b"):
            pairs = pairs.join(self.classes.select(
                F.col("cls").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
        pairs = pairs.where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        union = f"slice(array_sort(array_union(s_a, s_b)), 1, {SKETCH})"
        pairs = pairs.withColumn("u", F.expr(union)).withColumn(
            "est", F.expr("size(array_intersect(array_intersect(u, s_a), s_b)) / size(u)"))
        # Where the sketch of the union is the whole union, the estimate is exact.
        bar = F.when((F.size("u") < SKETCH), F.lit(self.percent / 100 - 1e-9)).otherwise(F.lit(_common(self.percent) / SKETCH - 1e-9))
        return pairs.where(F.col("est") >= bar).select("a", "b", "est")

    def read_sets(self, wanted: DataFrame) -> None:
        """Take the full sets, ``cls, shingles``, of all classes that pairs will be made of; texts move once."""
        needed = self.classes.join(wanted, "cls", "left_semi").select("cls", "rep_id")
        kept = self.texts.join(needed, self.texts["doc_id"].eqNullSafe(needed["rep_id"])).select("cls", "text")
        self.full = materialize(kept.mapInArrow(_full(self.width), "cls binary, shingles array<bigint>")
                                .dropDuplicates(["cls"]), "shingles")

    def prefixes(self, wanted: DataFrame) -> DataFrame:
        """``value, cls, n, place, alone``: the shingles that classes in ``wanted`` (``cls``) must share one of to be alike.

        Shingles are ordered by their frequency among these classes; ``alone`` is how many of a class no other one has.
        """
        posted = self.full.join(wanted, "cls", "left_semi").select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
        counted = posted.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
        shared = posted.join(counted, "value")
        alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cls"))
        rank = F.row_number().over(Window.partitionBy("cls").orderBy("freq", "value"))
        return materialize(shared.withColumn("alone", alone).withColumn("place", F.col("alone") + rank).where(
            f"100 * (n - place + 1) >= {self.percent} * n").select("value", "cls", "n", "place", "alone"), "prefixes")

    def prefix_pairs(self, prefix: DataFrame, starred: bool) -> DataFrame:
        """``a, b`` of the classes in ``prefix`` that can be alike though their labels differ.

        At the first shingle that two sets share, what follows it in the shorter rest must suffice for the
        similarity; no linked pair is lost. With ``starred`` only the pairs with the class of each shingle that has
        the fewest of its own.
        """
        told = prefix.join(self.labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "label", F.coalesce("label", "cls"))
        told = materialize(told, "told-prefixes")
        other = told.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "value", F.col("place").alias("place_b"),
                            F.col("label").alias("other"), F.col("alone").alias("alone_b"))
        if starred:
            other = other.groupBy("value").agg(F.min_by(F.struct("b", "n_b", "place_b", "other"), F.struct("alone_b", "b")).alias("pivot"))
            other = other.select("value", "pivot.*")
        alike = f"{100 + self.percent} * (1 + least(n - place, n_b - place_b)) >= {self.percent} * (n + n_b)"
        return told.join(other, "value").where(
            f"{'cls <> b' if starred else 'cls < b'} AND label <> other AND "
            f"100 * least(n, n_b) >= {self.percent} * greatest(n, n_b) AND {alike}").select(
            F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"))

    def verify(self, pairs: DataFrame) -> None:
        """Link the pairs whose full sets are alike, and join their components.

        New links join whole components, so only their labels go through the rounds again.
        """
        pairs = pairs.select("a", "b")
        for end in ("a", "b"):
            pairs = pairs.join(self.full.select(F.col("cls").alias(end), F.col("shingles").alias(f"f_{end}")), end)
        common = F.size(F.array_intersect("f_a", "f_b"))
        links = materialize(pairs.withColumn("common", common).where(
            100 * F.col("common") >= self.percent * (F.size("f_a") + F.size("f_b") - F.col("common"))).select("a", "b"), "links")
        if self.labels is None:
            self.labels = materialize(connected_components(links), "components")
        elif not links.isEmpty():
            roots = materialize(connected_components(_labelled(links, self.labels).select(
                F.col("label_a").alias("a"), F.col("label_b").alias("b"))), "roots").toDF("old", "root")
            moved = self.labels.join(roots, F.col("label") == F.col("old"), "left").select(
                "node", F.coalesce("root", "label").alias("label"))
            fresh = roots.toDF("node", "label").join(self.labels, "node", "left_anti")
            self.labels = materialize(moved.union(fresh), "components")


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    """``value, cls, alone, rare, size``: the retained values a class is looked up by, and the length of their lists.

    ``alone`` is how many retained values of the class no other class has; the more classes have its values, the
    less is ``rare``.
    """
    posted = classes.select("cls", "n", F.explode("sketch").alias("value"))
    counted = posted.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = posted.join(counted, "value")
    order = Window.partitionBy("cls").orderBy("freq", "value")
    held = F.least("n", F.lit(SKETCH))
    common = F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * percent / 100 - 1e-9)).otherwise(F.lit(_common(percent)))
    # The rarest held - common + 1 values; those no other class has come first and need no list.
    alone = held - F.count(F.lit(1)).over(Window.partitionBy("cls"))
    chosen = materialize(shared.withColumn("place", F.row_number().over(order)).withColumn("alone", alone)
                         .withColumn("rare", -F.sum("freq").over(Window.partitionBy("cls")))
                         .withColumn("spare", held - common + 1 - F.col("alone"))
                         .where("place <= spare").select("value", "cls", "alone", "rare"), "keys")
    sizes = chosen.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(chosen.join(sizes, "value"), "lists")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than
    ``width`` words has one shingle, without words none. Texts are linked when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable. Null and empty texts are linked with
    nothing and stay. Rows that repeat an id and a text share its fate; a null id takes the component's.
    Other columns are ignored. ``percent`` must be 80 or more: the bounds above are for that.
    """
    if percent < 80:
        raise ValueError("sketches are sized for a similarity of 0.8 or more")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = materialize(texts.mapInArrow(
        _sketch(width), f"doc_id {kind}, n bigint, cls binary, sketch array<bigint>"), "sketches")
    classes = materialize(marked.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep_id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    lists = _keys(classes, percent)
    found = _Links(classes, texts, width, percent)

    # Short lists give all their pairs; in a long one every class meets the list's least.
    short = lists.where(F.col("size") <= SHORT_LIST).groupBy("value").agg(F.sort_array(F.collect_list("cls")).alias("c"))
    paired = short.select(F.posexplode("c").alias("i", "a"), "c").select(
        "a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))
    # Of a long list, the class with the fewest values of its own meets all others, of several the one whose values
    # most classes have: in a group of near copies it is the one closest to what they were made from.
    # A list was written by one task; its rows are spread by their class before they are read again and again.
    long = materialize(lists.where(F.col("size") > SHORT_LIST).select("value", "cls", "alone", "rare").repartition("cls"), "long-lists")
    least = long.groupBy("value").agg(F.min_by("cls", F.struct("alone", "rare", "cls")).alias("pivot"))
    starred = long.join(least, "value").where("pivot <> cls").select(
        F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
    proposed = materialize(found.estimated(paired.union(starred).distinct()), "proposed")
    found.read_sets(proposed.select(F.col("a").alias("cls")).union(proposed.select("b")).union(long.select("cls")).distinct())
    # First each class with its likeliest smaller one: that joins most groups, and spares most other pairs.
    found.verify(proposed.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"))
    found.verify(_labelled(proposed, found.labels))

    # Long lists that still hold several components: further pivots, then the prefix join of what is left, first with
    # one class of each shingle: a group that the pivots left in parts would be paired out otherwise.
    for turn in range(PIVOTS + 1):
        if long.isEmpty():
            break
        told = long.join(found.labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "label", F.coalesce("label", "cls"))
        range_ = told.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        open_ = materialize(told.join(range_, "value"), "open-lists")
        if open_.isEmpty():
            break
        if turn < PIVOTS:
            # The component with the largest label: its class with the fewest values of its own meets all others.
            pivot = open_.where("label = high").groupBy("value").agg(
                F.min_by("cls", F.struct("alone", "rare", "cls")).alias("pivot"))
            pairs = open_.join(pivot, "value").where("label <> high").select(
                F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b"))
            found.verify(found.estimated(pairs.distinct()))
        else:
            prefix = found.prefixes(open_.select("cls").distinct())
            for starred in (True, False):
                found.verify(found.estimated(found.prefix_pairs(prefix, starred).distinct()))

    # The component's smallest id for each class, then for each row.
    told = classes.join(found.labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "rep_id", F.coalesce("label", "cls").alias("label"))
    smallest = told.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    of_class = told.join(smallest, "label").select("cls", "component_id")
    placed = marked.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, all columns. Ids should be unique."""
    kept = near_duplicates(docs, id_col, text_col, width, percent).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")

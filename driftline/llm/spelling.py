"""Spelling variants: words one edit apart, found by walking a trie as a relation.

The trie of the vocabulary is a distributed table of edges. Rows (word, position, node, edits) walk it level by
level, each level one join with the edges of that depth: on the word's own path, off it by one replaced or inserted
letter, and from there along equal letters only. Where a subtree holds one word, its rest is compared at once.

Two words that differ by one edit agree before it and after it, and one of both parts is at least as long as the other.
So there are two tries, of the words and of the words written backwards, and a word enters each at the middle:
a letter is exchanged only behind at least half of a word, where a node has few children, never near the root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialize

#: Runs of these letters are words.
LETTERS = "A-Za-zÀ-ÿ"

#: One in so many runs of a document loses a letter.
DROPPED = 97

#: Levels of the trie that one job builds.
_LEVELS = 16

#: Stands among a node's letters for the end of a word.
_END = "$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_letters: int = 5, least_count: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``word, n``: words of the texts with at least so many letters and occurrences.

    A word is a maximal run of ``LETTERS`` with A-Z in lower case. If ``DROPPED`` divides the CRC-32 h of
    ``<id>:<run>``, the run loses its letter h % length. A null id is written as nothing.
    """
    pattern = f"[{LETTERS}]{{{max(least_letters, 1)},}}+"
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(pattern), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # only A-Z change, and a plain run holds no other capitals
    runs = found.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % DROPPED == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") >= least_count) & (F.length("word") >= least_letters))


def _letter(text: str, place: Column) -> Column:
    """The letter at ``place`` (from 0), empty behind the last."""
    return F.substring(F.col(text), place + 1, F.lit(1))


def _rest(text: str, place: Column) -> Column:
    return F.substring(F.col(text), place + 1, F.length(text))


def _size_bit(size: Column) -> Column:
    """A bit for each length; all from 62 letters on have the same."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(size, F.lit(62)))


def trie_edges(words: DataFrame, first: int) -> DataFrame:
    """Edges from level ``first`` on: ``back, level, node, letter, words, sizes, only, only_n, letters``.

    A node is a prefix that several words share. An edge without a letter is the end of a word. ``words`` counts the
    words behind an edge and ``sizes`` has the bits of their lengths; if it is one, ``only`` is that word, else ``letters``
    are the next ones. A word has edges from the level on where a word that is one letter shorter enters. Built
    ``_LEVELS`` levels at a time from the words that still share their prefix, so a long word costs what it has in common.
    """
    found, open_words, start = [], words, first
    while True:
        stop = start + _LEVELS
        lowest = F.greatest(F.lit(start), F.floor((F.length("word") - 1) / 2).cast("int"))
        highest = F.least(F.length("word"), F.lit(stop - 1))
        spread = open_words.where(lowest <= highest).withColumn("level", F.explode(F.sequence(lowest, highest)))
        edges = spread.groupBy("back", "level", F.substring(F.col("word"), F.lit(1), F.col("level")).alias("node"),
                               _letter("word", F.col("level")).alias("letter")).agg(
            F.count(F.lit(1)).alias("words"), F.bit_or(_size_bit(F.length("word"))).alias("sizes"),
            F.min("word").alias("only"), F.min("n").alias("only_n"))
        # A node has at most one edge a letter and one end.
        edges = edges.withColumn("total", F.sum("words").over(Window.partitionBy("back", "level", "node"))).where(
            "total > 1").drop("total")
        found.append(materialize(edges, "edges"))
        shared = open_words.where(F.length("word") >= stop).groupBy(
            "back", F.substring(F.col("word"), F.lit(1), F.lit(stop)).alias("start")).agg(
            F.count(F.lit(1)).alias("together")).where("together > 1")
        open_words = open_words.withColumn("start", F.substring(F.col("word"), F.lit(1), F.lit(stop))).join(
            shared, ["back", "start"]).select("back", "word", "n")
        open_words = materialize(open_words, "open")
        if open_words.isEmpty():
            break
        start = stop
    edges = reduce(DataFrame.unionByName, found)
    next_letters = edges.groupBy("back", F.col("node").alias("child")).agg(F.array_join(F.collect_list(
        F.when(F.col("letter") == "", _END).otherwise(F.col("letter"))), "").alias("letters"))
    # Edges to a single word, which are most, have no letters to look up.
    columns = ["back", "level", "node", "letter", "words", "sizes"]
    alone = edges.where("words = 1").select(*columns, "only", "only_n", F.lit("").alias("letters"))
    shared = edges.where("words > 1").withColumn("child", F.concat("node", "letter")).join(
        next_letters, ["back", "child"], "left").select(*columns, F.lit(None).cast("string").alias("only"), "only_n",
                                                        F.coalesce("letters", F.lit("")).alias("letters"))
    edges = alone.unionByName(shared)
    return materialize(edges.sortWithinPartitions("level"), "trie")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Each state over the edges of its node: ``back, word, n, position, node, edits, other, other_n``.

    A row with ``other`` has arrived at a word; the others are the states of the next level.
    """
    at = F.col("position")
    states = states.select(
        "back", "word", "n", "position", "node", "edits", F.length("word").alias("size"), _letter("word", at).alias("here"),
        _letter("word", at + 1).alias("after"))

    def may(following: Column, longer: Column) -> Column:
        """Whether the words behind an edge can be the word with what follows, and so many letters longer."""
        size = F.col("size") + longer
        return F.when(F.col("words") == 1, F.length("only") == size).otherwise(
            (F.col("sizes").bitwiseAND(_size_bit(size)) != 0)
            & F.col("letters").contains(F.when(following == "", _END).otherwise(following)))

    # On the word's own path every edge is looked at: of two words the smaller letter is replaced, and the shorter
    # word takes a letter in, behind a run of it. So each pair is met from one side.
    here, after, letter = F.col("here"), F.col("after"), F.col("letter")
    off = states.where("edits = 0").join(edges, ["back", "node"]).withColumn("kind", F.explode(F.array_compact(F.array(
        F.when((letter == here) & (here != "") & (F.col("words") > 1), 0),
        F.when((here != "") & (letter > here) & may(after, F.lit(0)), 1),
        F.when((letter != "") & (letter != here) & may(here, F.lit(1)), 2)))))
    # Off it there is one edge to take, the one of the next letter; of the word's end, without a letter.
    on = states.where("edits = 1").withColumn("letter", here).join(edges, ["back", "node", "letter"]).where(
        may(after, F.length("node") - at)).withColumn("kind", F.lit(1))
    step = F.when(F.col("kind") == 2, 0).otherwise(F.length("letter"))
    reached = off.unionByName(on.select(*off.columns)).withColumn("position", at + step)
    arrives = (F.col("kind") > 0) & (F.col("words") == 1)
    depth = F.length("node") + F.length("letter")
    return reached.where(~arrives | (_rest("only", depth) == _rest("word", at))).select(
        "back", "word", "n", "position", F.concat("node", "letter").alias("node"),
        F.when(F.col("kind") > 0, 1).otherwise(0).alias("edits"),
        F.when(arrives, F.col("only")).alias("other"), F.when(arrives, F.col("only_n")).alias("other_n"))


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of the words (word, n) that differ by one inserted, deleted or replaced
    letter, each once. ``words`` must be distinct. The number of rounds is the longest prefix (or suffix) that two of
    them share."""
    both = materialize(words.select(F.explode(F.array(
        F.struct(F.lit(False).alias("back"), "word", "n"),
        F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word"), "n"))).alias("s")).select("s.*"), "words")
    least = both.agg(F.min(F.length("word"))).first()[0]
    if least is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    first = (least - 1) // 2
    edges = trie_edges(both, first)
    last = edges.agg(F.max("level")).first()[0]
    # A word enters where a change leaves at least as many letters before it as behind it.
    entry = F.floor(F.length("word") / 2)
    found, states = [], None
    for level in range(first, -1 if last is None else last + 1):
        entering = both.where(entry == level).select(
            "back", "word", "n", F.lit(level).alias("position"), F.substring(F.col("word"), F.lit(1), F.lit(level)).alias("node"),
            F.lit(0).alias("edits"))
        states = entering if states is None else states.unionByName(entering)
        reached = materialize(_step(states, edges.where(F.col("level") == level).drop("level")), "states")
        found.append(reached.where("other IS NOT NULL").select("back", "word", "n", "other", "other_n"))
        states = reached.where("other IS NULL").drop("other", "other_n")
    if not found:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where(F.lit(False))
    spelled = reduce(DataFrame.unionByName, found)
    turned = [F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)) for c in ("word", "other")]
    # A change in the very middle is met in both tries, and a letter taken into a run may be.
    pairs = spelled.select(turned[0].alias("x"), "n", turned[1].alias("y"), "other_n")
    swap = F.col("x") > F.col("y")
    return pairs.select(F.least("x", "y").alias("word"), F.when(swap, F.col("other_n")).otherwise(F.col("n")).alias("n"),
                        F.greatest("x", "y").alias("other"),
                        F.when(swap, F.col("n")).otherwise(F.col("other_n")).alias("other_n")).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word when forms are followed; a word without a form is its own.

    Each round doubles the steps, and forms lead to ever more frequent words, so the rounds are few.
    """
    steps = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = materialize(steps.where("root <> word").join(further, "root").select(
            "word", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")).unionByName(
            steps.where("root = word").withColumn("moved", F.lit(False))), "roots")
        if doubled.where("moved").isEmpty():
            return doubled.select("word", "root")
        steps = doubled.select("word", "root")


def spelling_groups(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts, as ``count_words`` counts them.

    Words are near if one inserted, deleted or replaced letter makes one the other. ``form`` is the near word of largest
    ``n`` (of several, the smallest in code-point order) if that is at least ``ratio`` times the word's, else null;
    ``root`` follows forms to the last. Null and empty texts have no words; a table without words gives no rows;
    repeated rows count again; other columns are ignored.
    """
    words = materialize(count_words(docs, least_letters, least_count, id_col, text_col), "vocabulary")
    pairs = one_edit_pairs(words)
    near = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("form"), F.col("other_n").alias("form_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("form"), F.col("n").alias("form_n")))).alias("s")).select("s.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(
        F.struct((-F.col("form_n")).alias("less"), "form", "form_n")).alias("best"))
    enough = F.col("best.form_n") >= ratio * F.col("n")
    formed = materialize(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.form_n")).alias("form_n")), "forms")
    return formed.join(roots_of(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")

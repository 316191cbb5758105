"""Toxicity by two Kneser-Ney language models of bytes, one per class.

Both classes count their own 6-, 5- and 4-grams of lower-cased bytes (the lower of these as Kneser-Ney
continuation counts); below that, rare expressions back off to continuation counts that the classes
share. A text is compared by its toxic and its ordinary log-likelihood, each divided by the length: over
the whole text, and over the window of 24 bytes where they differ most, so that a long text doesn't
hide a short insult. Two weights and an offset turn both figures into a score.

Only the labelled training texts are counted, exactly and by Spark, and no gram shares another's counts. A byte's
log-ratio depends on the gram that ends there alone; a gram of which training knows only the end, or nothing, backs
off to what is known of its shorter ends, so it needs no row of its own. With at most 2^BITS distinct training grams
their counts are broadcast. Beyond, the distinct grams of each chunk of texts are joined with a table of
their ratios. Both give the same figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.arrow import LOWER, text_chunks
from driftline.session import discard, materialize

#: Longest gram, the longest shared by the classes, and the discount.
TOP, SHARED, DISCOUNT = 6, 3, 0.75

#: Most distinct training grams whose counts are broadcast, as a power of two; more are joined.
BITS = 22

#: Bytes of a window.
WINDOW = 24

#: One training text in so many is kept from the counts while the weights are fitted on it, at most FIT_ROWS of them.
FIT_EVERY, FIT_ROWS = 5, 20_000

#: Most labels, and bytes of their ids as text, that are broadcast to the texts; more are joined by a shuffle.
LABELS, LABEL_BYTES = 1 << 21, 64 << 20

#: From this score on a text is called toxic.
THRESHOLD = 0.7

#: Bytes of text counted or scored at once, and of a chunk whose grams are joined with the table.
_CHUNK, _JOINED = 1 << 20, 2 << 20


def _grams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the TOP bytes that end there as one number, and where each is in the padded rows.

    Each row is preceded by TOP - 1 line feeds.
    """
    rows = np.repeat(np.arange(1, len(at)), np.diff(at))
    place = np.arange(len(body)) + rows * (TOP - 1)
    padded = np.full(len(body) + (len(at) - 1) * (TOP - 1), 10, np.uint64)
    padded[place] = LOWER[body]
    grams = padded.copy()
    for k in range(1, TOP):
        grams[k:] |= padded[:-k] << np.uint64(8 * k)
    return grams, place


#: Kinds of a text when it is counted: its class, plus 2 if the weights are fitted on it; or no training text.
_FITTED, _UNLABELLED = 2, 4

_COUNTS = "gram bigint, n0 bigint, n1 bigint, m0 bigint, m1 bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of a batch's texts with their count in each class: of all training texts, and without the fitted."""
    for batch in batches:
        kind = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for first, last, body, at in text_chunks(batch.column(0), _CHUNK):
            grams, place = _grams(body, at)
            label = np.repeat(kind[first:last], np.diff(at)).astype(np.uint64)
            found, n = np.unique(grams[place] << np.uint64(3) | label, return_counts=True)
            whole = found >> np.uint64(3)
            start = np.flatnonzero(np.diff(whole, prepend=np.uint64(1 << 60)))  # no gram has so many bits
            counts = np.zeros((len(start), _UNLABELLED + 1), np.int64)
            counts[np.repeat(np.arange(len(start)), np.diff(start, append=len(whole))),
                   (found & np.uint64(7)).astype(np.int64)] = n
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[start].astype(np.int64)), *[pa.array(c) for c in (
                    counts[:, 0] + counts[:, 2], counts[:, 1] + counts[:, 3], counts[:, 0], counts[:, 1])]],
                ["gram", "n0", "n1", "m0", "m1"])


def count_grams(texts: DataFrame) -> DataFrame:
    """Every gram of ``texts`` (text, kind) with its counts, written once."""
    return materialize(texts.select("text", "kind").mapInArrow(_count, _COUNTS).groupBy("gram").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "m0", "m1")]), "grams")


#: Columns of the counts of one class pair: of all training texts, and without those the weights are fitted on.
CLASSES = {"ratio": ("n0", "n1"), "fitted": ("m0", "m1")}


class Model:
    """Counts of whole grams of both classes, and the log-ratio of any gram by the orders that follow from them.

    Only the grams and their counts travel; each worker derives the shorter orders from them once.
    """

    def __init__(self, rows: pa.Table) -> None:
        grams, *counts = [rows.column(i).to_numpy() for i in range(3)]
        at = np.argsort(grams)
        self.grams, self.counts = grams[at], np.stack([c[at] for c in counts])
        self.tables = {}

    def __getstate__(self) -> dict:
        """Steps between grams and small counts, compressed: the driver and every executor keep a broadcast on disk."""
        def packed(values: np.ndarray) -> tuple[bytes, int, tuple[int, ...]]:
            raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()  # equal bytes of all numbers together
            return pa.compress(raw, "zstd", asbytes=True), len(raw), values.shape

        return {"grams": packed(np.diff(self.grams, prepend=0)), "counts": packed(self.counts)}

    def __setstate__(self, state: dict) -> None:
        def values(compressed: bytes, size: int, shape: tuple[int, ...]) -> np.ndarray:
            raw = np.frombuffer(pa.decompress(compressed, size, "zstd", asbytes=True), np.uint8)
            return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(shape)

        self.grams, self.counts, self.tables = np.cumsum(values(*state["grams"])), values(*state["counts"]), {}

    def _derive(self) -> None:
        """By order the counts of its grams, and of each context the sums and how many grams each class holds."""
        grams, counts = self.grams, self.counts
        for order in range(TOP, 0, -1):
            self.tables[order, False] = grams, counts
            first = np.flatnonzero(np.diff(grams >> 8, prepend=-1))
            self.tables[order, True] = grams[first] >> 8, np.concatenate(
                [np.add.reduceat(c, first, axis=1) if len(first) else c for c in (counts, (counts > 0).astype(np.int64))])
            # The next order: in how many distinct contexts its grams stand, by class; pooled when shared.
            ends = grams & ((1 << 8 * (order - 1)) - 1)
            at = np.argsort(ends, kind="stable")
            held = (counts > 0)[:, at].astype(np.int64)
            if order - 1 <= SHARED:
                held[:] = held.max(0)
            first = np.flatnonzero(np.diff(ends[at], prepend=-1))
            grams, counts = ends[at][first], np.add.reduceat(held, first, axis=1) if len(first) else held

    def _counts(self, order: int, context: bool, asked: np.ndarray) -> np.ndarray:
        """The counts of each of ``asked``, zeros where training has none."""
        grams, counts = self.tables[order, context]
        if not len(grams):
            return np.zeros((len(counts), len(asked)), np.int64)
        at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
        return np.where(grams[at] == asked, counts[:, at], 0)

    def _probabilities(self, order: int, asked: np.ndarray) -> np.ndarray:
        if not order:
            return np.full((2, len(asked)), 1 / 256)
        ends, which = np.unique(asked & ((1 << 8 * (order - 1)) - 1), return_inverse=True)
        shorter = self._probabilities(order - 1, ends)[:, which]
        own, around = self._counts(order, False, asked), self._counts(order, True, asked >> 8)
        total, kinds = around[:2], around[2:]
        return np.where(total > 0, (np.maximum(own - DISCOUNT, 0) + DISCOUNT * kinds * shorter) / np.maximum(total, 1), shorter)

    def ratios(self, asked: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of the last byte of each of ``asked``, in ascending order."""
        if not self.tables:
            self._derive()
        logs = np.log(np.maximum(self._probabilities(TOP, asked.astype(np.int64)), 1e-12))
        return (logs[1] - logs[0]).astype(np.float32)


def gram_ratios(counted: DataFrame) -> DataFrame:
    """``gram, ratio, fitted``: log P(toxic) - log P(ordinary) of a gram's last byte given the ones before it.

    ``ratio`` is by all training texts, ``fitted`` by those the weights are not fitted on. A context has at most
    256 grams, and so has an ending, so no group of the shuffles is large.
    """
    both = tuple(CLASSES.values())
    levels = {TOP: counted.select("gram", "n0", "n1", "m0", "m1")}
    for order in range(TOP - 1, 0, -1):
        # Continuation counts: in how many distinct contexts the shorter gram stands, by class; pooled when shared.
        longer = levels[order + 1]
        counts = []
        for classes in both:
            any_class = " OR ".join(f"{c} > 0" for c in classes)
            counts += [F.sum(F.expr(f"int({any_class if order <= SHARED else f'{c} > 0'})")).alias(c) for c in classes]
        levels[order] = longer.groupBy(F.expr(f"gram & {(1 << 8 * order) - 1}L").alias("gram")).agg(*counts)
    names = [c for classes in both for c in classes]
    known = None  # probabilities of the grams that are one byte shorter
    for order in range(1, TOP + 1):
        context = Window.partitionBy(F.expr("shiftright(gram, 8)"))
        sums = {f"d_{c}": F.sum(c).over(context) for c in names} | {
            f"t_{c}": F.sum(F.expr(f"int({c} > 0)")).over(context) for c in names}
        level = levels[order].withColumns(sums).withColumn("ending", F.expr(f"gram & {(1 << 8 * (order - 1)) - 1}L"))
        if known is None:
            level = level.withColumns({f"p_{c}": F.lit(1 / 256) for c in names})
        else:
            level = level.join(known, "ending")  # each ending of a gram is in the level below
        known = level.select("gram", *[F.expr(
            f"IF(d_{c} > 0, (greatest({c} - {DISCOUNT}D, 0D) + {DISCOUNT}D * t_{c} * p_{c}) / d_{c}, p_{c})").alias(f"p_{c}")
            for c in names])
        if order < TOP:
            known = known.withColumnRenamed("gram", "ending")
    log = "cast(ln(greatest({0}1, 1e-12D)) - ln(greatest({0}0, 1e-12D)) AS float)"
    return known.select("gram", F.expr(log.format("p_n")).alias("ratio"), F.expr(log.format("p_m")).alias("fitted"))


def _mean_peak(column: pa.Array, ratios, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``mean, peak`` of each text: its log-ratio per byte, and that of its most toxic window.

    ``ratios`` gives the log-ratios of an array of distinct grams in ascending order.
    """
    mean, peak = np.zeros(len(column)), np.zeros(len(column))
    for first, last, body, at in text_chunks(column, limit):
        if not len(body):
            continue
        grams, place = _grams(body, at)
        found, which = np.unique(grams[place], return_inverse=True)
        total = np.concatenate([[0.0], np.cumsum(ratios(found).astype(np.float64)[which])])
        size = np.diff(at)
        some = np.maximum(size, 1)
        mean[first:last] = (total[at[1:]] - total[at[:-1]]) / some
        peak[first:last] = mean[first:last]
        long = np.flatnonzero(size >= WINDOW)
        if len(long):
            window = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
            edges = np.stack([at[long], at[long + 1] - WINDOW + 1], 1).ravel()
            edges[-1] = min(edges[-1], len(window))
            peak[first + long] = np.maximum.reduceat(np.append(window, -np.inf), edges)[::2]
    return mean, peak


def _found(grams: np.ndarray, values: np.ndarray):
    """Values by gram; ``grams`` ascend and hold every gram that is asked for."""
    def ratios(asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(grams, asked.astype(np.int64))
        if len(asked) and (at[-1] >= len(grams) or (grams[at] != asked.astype(np.int64)).any()):
            raise ValueError("a gram of the texts has no ratio")
        return values[at]

    return ratios


def _figures(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = broadcast.value.ratios
        for batch in batches:
            mean, peak = _mean_peak(batch.column("text"), ratios, _CHUNK)
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mean), pa.array(peak)], [*names, "mean", "peak"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk."""
    number = TaskContext.get().partitionId() << 32
    filled = 0
    for batch in batches:
        for first, last, body, _ in text_chunks(batch.column("text"), _JOINED):
            if filled and filled + len(body) > _JOINED:
                number, filled = number + 1, 0
            filled += len(body)
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(last - first, number, np.int64))], [*part.schema.names, "chunk"])


def _chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each chunk; those of a chunk in several batches may come several times."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        edges = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:]):
            for _, _, body, at in text_chunks(batch.column("text").slice(first, last - first), _JOINED):
                grams, place = _grams(body, at)
                found = np.unique(grams[place]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), chunks[first], np.int64)), pa.array(found)], ["chunk", "gram"])


def _chunk_figures(texts: pa.Table, grams: pa.Table) -> pa.Table:
    keys = grams["gram"].to_numpy()
    order = np.argsort(keys)
    mean, peak = _mean_peak(texts["text"].combine_chunks() if texts.num_rows else pa.array([], pa.string()),
                            _found(keys[order], grams["ratio"].to_numpy()[order]), _JOINED)
    return texts.drop_columns(["text", "chunk"]).append_column("mean", pa.array(mean)).append_column("peak", pa.array(peak))


class Ratios:
    """The ratios by counts of training grams: broadcast if there are at most 2^bits grams, else joined."""

    def __init__(self, counted: DataFrame, bits: int) -> None:
        self.counted, self.small, self.sent = counted, counted.count() <= 1 << bits, None

    def figures(self, texts: DataFrame, ratio: str = "ratio") -> DataFrame:
        """``texts`` without ``text`` and with ``mean`` and ``peak``."""
        others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
        schema = f"{others}, mean double, peak double"
        if self.small:
            one, other = CLASSES[ratio]
            model = Model(self.counted.select("gram", one, other).where(f"{one} > 0 OR {other} > 0").toArrow())
            self.sent = texts.sparkSession.sparkContext.broadcast(model)
            return texts.mapInArrow(_figures(self.sent), schema)
        whole = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
        chunks = materialize(texts.mapInArrow(_numbered, f"{whole}, chunk bigint"), "chunks")
        pairs = materialize(chunks.select("chunk", "text").mapInArrow(
            _chunk_grams, "chunk bigint, gram bigint").distinct(), "pairs")
        # The grams of the texts that training lacks, with counts of 0, get their ratio with the others.
        none = [F.lit(0).cast("long").alias(c) for classes in CLASSES.values() for c in classes]
        grams = pairs.select("gram").distinct().select("gram", *none).union(
            self.counted.select("gram", *[c for classes in CLASSES.values() for c in classes]))
        table = gram_ratios(grams.groupBy("gram").agg(*[F.sum(c).alias(c) for classes in CLASSES.values() for c in classes]))
        pairs = pairs.join(table.select("gram", F.col(ratio).alias("ratio")), "gram")
        return chunks.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_chunk_figures, schema)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights (offset first) over standardized figures, with their centre and spread."""
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    weights = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [penalty * len(x) / 10] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        grad = z.T @ (p - y) + ridge @ weights
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(weights)), grad)
        weights -= np.clip(step, -3, 3)
    return weights, centre, spread


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", bits: int = BITS, fit_rows: int = FIT_ROWS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, mean, peak`` per row of ``docs``.

    Labels are learned only from rows whose crc32 of the id as text isn't 1 modulo 3; of several labels
    of an id the largest holds, null labels and ids are no labels. The weights are fitted on one of these texts
    in FIT_EVERY, the first ``fit_rows`` of them by a hash of the id, with the counts of all others; scores come
    from the counts of all of them. Only the text enters a score. Null and empty texts have both figures 0 and the
    score these give. Without training text in both classes, every score is the toxic share of the labels, or 0.
    Repeated rows give repeated rows; other columns are ignored.
    """
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    # Candidates for the fit by the hash that orders them; the last one taken bounds the others.
    place = F.when(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FIT_EVERY)) == 0,
                   F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)))
    last = texts.select("doc_id").join(known, "doc_id").select(place.alias("place")).where("place IS NOT NULL").orderBy(
        "place").limit(fit_rows).agg(F.max("place")).first()[0]
    in_fit = F.lit(False) if last is None else F.coalesce(place <= F.lit(last), F.lit(False))
    many, wide = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0))).first()
    sent = F.broadcast(known) if many <= LABELS and wide <= LABEL_BYTES else known
    # The training texts are read twice, and only they move.
    labelled = materialize(texts.join(sent, "doc_id").withColumn(
        "kind", F.col("toxic") + F.when(in_fit, _FITTED).otherwise(0)), "training")
    counted = count_grams(labelled)
    have = counted.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n0", "n1", "m0", "m1")]).first()

    scored = texts.withColumn("held_out", held(F.col("doc_id")))
    if not have["n0"] or not have["n1"]:
        share = labelled.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        discard(labelled)
        done = scored.drop("text").withColumns({"mean": F.lit(0.0), "peak": F.lit(0.0), "score": F.lit(float(share))})
    else:
        ratios = Ratios(counted, bits)
        sample = ratios.figures(labelled.where(F.col("kind") >= _FITTED).select(
            "doc_id", "toxic", "text"), "fitted").toArrow()
        if ratios.sent is not None:
            ratios.sent.destroy()
        discard(labelled)
        x = np.column_stack([sample["mean"].to_numpy(), sample["peak"].to_numpy()])
        y = sample["toxic"].to_numpy().astype(float)
        if have["m0"] and have["m1"] and 0 < y.sum() < len(y):
            weights, centre, spread = fit(x, y)
        else:  # nothing to fit on: one nat a byte over the window stands for toxic
            weights, centre, spread = np.array([-2.0, 1.0, 3.0]), np.array([0.0, 0.5]), np.array([0.5, 0.25])
        scale = weights[1:] / spread
        offset = float(weights[0] - (scale * centre).sum())
        linear = F.lit(offset) + F.col("mean") * float(scale[0]) + F.col("peak") * float(scale[1])
        done = ratios.figures(scored).withColumn("score", 1 / (1 + F.exp(-linear)))
    return done.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
                       "mean", "peak")

"""Quality from trusted positives and unlabelled text, without any trusted negatives.

A text is described by how it is written: its kinds of characters, its words, its lines and how much of them repeats.
Every text of the corpus is unlabelled web text, the texts labelled good are the positives. The share of good texts
among all (the class prior) is estimated first: a classifier of positives against all texts orders them, and where
its best scores hold next to nothing but positives, the share of all texts there over the share of positives is the
prior. Then a logistic model minimises the non-negative unbiased risk

    prior * E_good[l(g)] + max(0, E_all[l(-g)] - prior * E_good[l(-g)]),   l(z) = ln(1 + exp(-z)),

whose score is the chance that a text is good. Both are fitted by Newton steps whose sums Spark takes over all rows;
what reaches the driver is a matrix of the features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrow import LOWER, mixed, span_hashes, text_chunks, word_spans
from driftline.session import materialize

#: From this score on a text is called good.
THRESHOLD = 0.3

#: Rounds of a fit at most, its ridge, and the size of a step at which it ends.
ROUNDS, RIDGE, SMALL = 25, 1e-3, 1e-4

#: Bins of the scores that the prior is read from, and the odds of its bound.
BINS, ODDS = 1000, 0.1

#: Features are cut off at so many standard deviations.
FAR = 4.0

#: Bytes of text described at once.
_CHUNK = 2 << 20

# Kinds of a byte: small letter, capital, digit, white space, punctuation, exclamation mark, other sign, beyond ASCII, control.
_KINDS = np.full(256, 8, np.uint8)
for _kind, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\n\v\f\r", b".,;:?'\"-()", b"!",
                                b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)]):
    _KINDS[list(_bytes)] = _kind
_SPACE = _KINDS == 3
_SIGN = (_KINDS == 5) | (_KINDS == 6)

#: Features of a text.
FEATURES = ["bytes", "words", "small", "capital", "digit", "space", "punctuation", "exclamation", "sign", "beyond", "control",
            "word_length", "sign_ends", "capital_starts", "distinct", "commonest", "pairs_repeated", "triples_repeated",
            "near_repeats", "line_length", "lines_repeated"]


def _distinct(rows: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest of them stands there."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))) if len(rows) else np.zeros(0, np.int64)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, rows[first], np.diff(first, append=len(rows)))
    return np.bincount(rows[first], minlength=count), most


def _described(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The features of each text, one row each."""
    count = len(at) - 1
    size = np.diff(at)
    some = np.maximum(size, 1)
    row = np.repeat(np.arange(count), size)
    kinds = np.bincount(row * 9 + _KINDS[body], minlength=9 * count).reshape(count, 9) / some[:, None]

    starts, ends, rows = word_spans(body, at, ~_SPACE)
    hashes = span_hashes(LOWER[body], starts, ends)
    words = np.bincount(rows, minlength=count)
    of = np.maximum(words, 1)
    share = lambda mask: np.bincount(rows[mask], minlength=count) / of
    sign_ends = share(_SIGN[body[ends - 1]]) if len(ends) else np.zeros(count)
    capital_starts = share(_KINDS[body[starts]] == 1) if len(starts) else np.zeros(count)
    distinct, most = _distinct(rows, hashes, count)
    repeated = []
    run = hashes
    for length in (2, 3):
        run = mixed(run[:-1] * np.uint64(31) + hashes[length - 1:]) if len(hashes) >= length else np.zeros(0, np.uint64)
        whole = rows[:len(run)] == rows[length - 1:] if len(run) else np.zeros(0, bool)
        n = np.bincount(rows[:len(run)][whole], minlength=count)
        repeated.append(1 - _distinct(rows[:len(run)][whole], run[whole], count)[0] / np.maximum(n, 1))
        repeated[-1][n == 0] = 0
    close = np.zeros(len(hashes), bool)
    for step in (1, 2):
        close[step:] |= (hashes[step:] == hashes[:-step]) & (rows[step:] == rows[:-step])

    line_starts, line_ends, line_rows = word_spans(body, at, np.arange(256) != 10)
    lines = np.bincount(line_rows, minlength=count)
    line_kinds, _ = _distinct(line_rows, span_hashes(body, line_starts, line_ends), count)
    columns = [np.log1p(size), np.log1p(words), *kinds.T, size / of, sign_ends, capital_starts, distinct / of,
               most / of, *repeated, share(close) if len(close) else np.zeros(count), np.log1p(size / np.maximum(lines, 1)),
               (lines - line_kinds) / np.maximum(lines, 1)]
    return np.column_stack(columns)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, body, at in text_chunks(batch.column("text"), _CHUNK):
            found = _described(body, at).astype("<f4")
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(first, last - first) for c in others], pa.array([r.tobytes() for r in found], pa.binary())],
                [*others, "features"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), len(FEATURES)).astype(np.float64)


def _inputs(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """What the models are linear in: one, the standardized features and their squares."""
    z = np.clip((features - centre) / spread, -FAR, FAR)
    return np.column_stack([np.ones(len(z)), z, z * z / FAR])


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """Sums over all rows of the vectors that ``sums(features, good)`` gives for each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + sums(_matrix(batch.column("features")), batch.column("good").to_numpy(zero_copy_only=False))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "part"])

    found = rows.select("features", "good").mapInArrow(run, "place bigint, part double").groupBy("place").agg(
        F.sum("part").alias("part")).sort("place").toArrow()
    return found["part"].to_numpy()


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Fit:
    """Models over a table ``features, good`` of all texts."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        sums = _summed(rows, lambda f, good: np.concatenate([[len(f), good.sum()], f.sum(0), (f * f).sum(0)]))
        self.all, self.good = sums[0], sums[1]
        d = len(FEATURES)
        self.centre = sums[2:2 + d] / self.all
        self.spread = np.sqrt(np.maximum(sums[2 + d:] / self.all - self.centre ** 2, 0)) + 1e-6

    def _moments(self, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Means over all texts and over the good ones: of the inputs, of them by score, of softplus, and the curvatures."""
        centre, spread = self.centre, self.spread

        def sums(features: np.ndarray, good: np.ndarray) -> np.ndarray:
            x = _inputs(features, centre, spread)
            z = x @ weights
            p, soft = _logistic(z), np.logaddexp(0, z)
            parts = []
            for mask in (np.ones(len(x), bool), good):
                xs, ps = x[mask], p[mask]
                parts += [xs.sum(0), ps @ xs, [soft[mask].sum()], ((xs * (ps * (1 - ps))[:, None]).T @ xs).ravel()]
            return np.concatenate(parts)

        total = _summed(self.rows, sums)
        d = len(weights)
        out, at = [], 0
        for n in (self.all, self.good):
            for size in (d, d, 1, d * d):
                out.append(total[at:at + size] / n)
                at += size
        return tuple(out)

    def _newton(self, direction) -> np.ndarray:
        """Weights after Newton steps of ``direction(moments)``, which gives a gradient and a curvature."""
        d = 2 * len(FEATURES) + 1
        weights, ridge = np.zeros(d), RIDGE * np.eye(d)
        ridge[0, 0] = 1e-9
        for _ in range(ROUNDS):
            gradient, curvature = direction(self._moments(weights))
            step = np.linalg.solve(curvature.reshape(d, d) + ridge + 1e-9 * np.eye(d), gradient + ridge @ weights)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))  # no step runs away
            weights = weights - step
            if np.abs(step).max() < SMALL:
                break
        return weights

    def prior(self) -> float:
        """The share of good texts among all: the least ratio, over scores, of both shares above a score, with a bound."""
        def apart(m):
            _, by_score_all, _, curve_all, mean_good, by_score_good, _, curve_good = m
            return (by_score_all - (mean_good - by_score_good)) / 2, (curve_all + curve_good) / 2

        weights = self._newton(apart)
        centre, spread = self.centre, self.spread

        def bins(features: np.ndarray, good: np.ndarray) -> np.ndarray:
            place = np.minimum((_logistic(_inputs(features, centre, spread) @ weights) * BINS).astype(int), BINS - 1)
            return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place[good], minlength=BINS)]).astype(float)

        counts = _summed(self.rows, bins).reshape(2, BINS)[:, ::-1].cumsum(1)
        above_all, above_good = counts[0] / self.all, counts[1] / self.good
        some = above_good > 0
        slack = np.sqrt(np.log(4 / ODDS) / 2 / self.all) + np.sqrt(np.log(4 / ODDS) / 2 / self.good)
        ratio, bound = above_all[some] / above_good[some], slack / above_good[some]
        return float(np.clip(ratio[np.argmin(ratio + bound)], 1 / self.all, 1.0))

    def weights(self, prior: float) -> np.ndarray:
        """Weights of least non-negative unbiased risk."""
        def risk(m):
            _, by_score_all, soft_all, curve_all, mean_good, by_score_good, soft_good, _ = m
            if soft_all[0] - prior * soft_good[0] >= 0:
                return by_score_all - prior * mean_good, curve_all
            # The risk of the bad texts can't be less than none: a step back.
            return prior * by_score_good - by_score_all, curve_all

        return self._newton(risk)


def _score(centre: np.ndarray, spread: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _logistic(_inputs(_matrix(batch.column("features")), centre, spread) @ weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
                                             ["doc_id", "held_out", "score"])

    return run


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; ``score`` is the chance that a text is good.

    Trusted positives are the texts labelled 1 whose crc32 of the id as text isn't 0 modulo 5 (of several labels of an
    id the largest holds; null ids and labels are none). Texts labelled 0 are unlabelled text like all others. ``prior``
    is the share of good texts, estimated if it isn't given. Only the text enters a score; null and empty texts have
    the features of an empty text. Without any trusted positive every score is 0. Repeated rows count and come out
    again; other columns are ignored; an empty table gives no rows.
    """
    trusted = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).where(
        "label = 1").select("doc_id", F.lit(True).alias("good"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    described = texts.withColumn("held_out", _held_out(F.col("doc_id"))).mapInArrow(
        _describe, f"doc_id {kind}, held_out boolean, features binary")
    rows = materialize(described.join(trusted, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))), "features")
    if rows.where("good").isEmpty():
        done = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        fit = Fit(rows)
        weights = fit.weights(fit.prior() if prior is None else prior)
        done = rows.select("doc_id", "held_out", "features").mapInArrow(
            _score(fit.centre, fit.spread, weights), f"doc_id {kind}, held_out boolean, score double")
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

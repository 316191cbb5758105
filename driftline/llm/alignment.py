"""Alignment of the tokens that two tokenizers make of the same bytes.

Every token points to the token farthest to the right that overlaps it (itself, if none goes further), and the
pointers are doubled until they stand still: each then leads to the last token of its connected component, which
labels a group. Both sides end where a group ends, so a group is the smallest piece that both cut alike.

Documents are encoded once, in chunks of bounded size. A chunk leaves its distinct pairs of linked ids, with the
number of its documents that hold each, and every document leaves which of them it holds how often; what is shuffled
for the corpus-wide counts grows with the distinct pairs of a chunk, not with its tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.session import materialize

#: Bytes of text in a chunk; one longer document is a chunk of its own.
CHUNK = 8 << 20

#: Texts longer than so many characters are encoded in parts, cut before a space that no token can span.
PART = 1 << 18


class Coder(Protocol):
    """A tokenizer with the bytes of each of its entries."""

    entries: pa.Array

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of a space followed by each part."""


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library.

    Where the merges stand in the order of their ids, as ranks do, the ``tiktoken`` library encodes by them, several
    times as fast and with equal ids; any other file goes through the ``tokenizers`` library itself.
    """

    def __init__(self, source: bytes, pattern: str) -> None:
        model = json.loads(source)["model"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        size = max(model["vocab"].values()) + 1
        entries = [b""] * size
        for entry, number in model["vocab"].items():
            entries[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.entries = pa.array(entries, pa.large_binary())
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        singles = [model["vocab"][c] for c in byte_of if c in model["vocab"]]
        self._own = None
        if merged == sorted(merged) and len(singles) == 256 and max(singles) < min(merged, default=size):
            ranks = {entries[n]: n for n in [*singles, *merged]}
            self._ranks = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        else:
            self._own = Tokenizer.from_str(source.decode())
            self._own.encode_special_tokens = True

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        if self._own is not None:
            return [np.array(e.ids, np.uint32) for e in self._own.encode_batch([f" {p}" for p in parts], add_special_tokens=False)]
        return [self._ranks.encode_to_numpy(f" {p}", disallowed_special=()) for p in parts]


class Pieces:
    """A model of the ``sentencepiece`` library, which puts the space before a text itself."""

    def __init__(self, source: bytes, pattern: str) -> None:
        self._own = sentencepiece.SentencePieceProcessor(model_proto=source)
        pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        byte = re.compile("<0x([0-9A-Fa-f]{2})>")
        self.entries = pa.array([
            bytes([int(byte.fullmatch(p)[1], 16)]) if self._own.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)], pa.large_binary())

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self._own.encode(parts, num_threads=1)]


@lru_cache(maxsize=4)
def _coder(kind: type, source: bytes, pattern: str) -> Coder:
    return kind(source, pattern)


#: Before this space a text may be cut: no token of either kind goes from a character over a space to the next.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str, limit: int = PART) -> list[str]:
    """Parts of a text; each but the first follows a space, so that a space and a part are bytes of ``' ' + text``."""
    found, start = [], 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if cut is None:
            break
        found.append(text[start:cut.start()])
        start = cut.end()
    return [*found, text[start:]]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, from 0, by pointer jumping.

    ``ends`` are the byte ends of the tokens of both sides in order; both sides end at the same byte.
    """
    n = len(ends_a)
    # The token of the other side that covers a token's last byte is the farthest to the right that overlaps it.
    over = np.searchsorted(ends_b, ends_a) + n
    under = np.searchsorted(ends_a, ends_b)
    itself = np.arange(n, n + len(ends_b))
    further = np.zeros(len(ends_b), bool)
    if n:
        further = ends_a[np.minimum(under, n - 1)] > ends_b
    points = np.concatenate([over, np.where(further, under, itself)])
    while True:
        doubled = points[points]
        if (doubled == points).all():
            break
        points = doubled
    last = np.zeros(n + len(ends_b), np.int64)
    last[itself[~further]] = 1
    number = np.cumsum(last) - 1
    label = number[points]
    return label[:n], label[n:]


def _links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token of either side of every overlapping pair, and the byte where the overlap ends."""
    size = int(ends_a[-1]) + 1 if len(ends_a) else 0
    stop_a, stop_b = np.zeros(size, bool), np.zeros(size, bool)
    stop_a[ends_a], stop_b[ends_b] = True, True
    ends = np.flatnonzero(stop_a | stop_b)
    stop_a, stop_b = stop_a[ends], stop_b[ends]
    return np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b, ends


def _digits(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below ``count`` before a place for its separator, and which cells are used."""
    width = len(str(max(count - 1, 1)))
    places = 10 ** np.arange(width - 1, -1, -1)
    numbers = np.arange(count)[:, None]
    cells = np.zeros((count, width + 1), np.uint8)
    cells[:, :-1] = numbers // places % 10 + 48
    used = np.ones((count, width + 1), bool)
    used[:, :-2] = numbers >= places[:-1]
    return cells, used


_digits_of = lru_cache(maxsize=2)(_digits)


def _listed(ids: np.ndarray, separators: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Each id in decimal digits followed by its separator, and where each ends."""
    cells, used = digits[0][ids], digits[1][ids]
    cells[:, -1] = separators
    return cells[used].tobytes(), np.cumsum(digits[1].sum(1)[ids])


def _written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray,
             digits: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """All groups as ``a1,a2|b1;...;`` and where each group ends."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    size_a, size_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    to_a, to_b = np.cumsum(size_a), np.cumsum(size_b)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + (to_b - size_b)[group_a]] = ids_a
    ids[np.arange(len(ids_b)) + to_a[group_b]] = ids_b
    ends = to_a + to_b
    marks[ends - size_b - 1] = ord("|")
    marks[ends - 1] = ord(";")
    body, places = _listed(ids, marks, digits)
    return body, places[ends - 1]


def _entries(coder: Coder, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the bytes of their entries joined, and the byte end of each."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    taken = coder.entries.take(pa.array(flat))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, np.int64)[taken.offset:taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if len(taken) and data is not None else np.zeros(0, np.uint8)
    return flat, body, ends[1:] - ends[0]


def _checked(ids: list[np.ndarray], coder: Coder, texts: list[bytes]) -> np.ndarray:
    """Whether the joined entries of each text are a space and the text."""
    _, body, ends = _entries(coder, ids)
    stops = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    at = np.concatenate([[0], ends])[stops]
    return np.array([body[at[i]:at[i + 1]].tobytes() == b" " + text for i, text in enumerate(texts)], bool)


class _Chunk:
    """Encoded documents that are aligned together."""

    def __init__(self) -> None:
        self.rows: list[int | None] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list[int | None], texts: list[str], left: Coder, right: Coder) -> None:
        """Encode some texts; where a side doesn't give back the bytes, neither has tokens."""
        parts = [parts_of(t) if t else [] for t in texts]
        flat = [p for each in parts for p in each]
        stops = np.cumsum([len(p) for p in parts])[:-1]
        sides = []
        for coder in (left, right):
            ids = coder.encode(flat) if flat else []
            per_text = [list(x) for x in np.split(np.arange(len(ids)), stops)]
            sides.append([np.concatenate([ids[i] for i in each]) if each else np.zeros(0, np.uint32) for each in per_text])
        bodies = [t.encode() for t in texts]
        good = np.array([bool(t) for t in texts], bool)
        for coder, ids in zip((left, right), sides):
            good &= _checked(ids, coder, bodies)
        none = np.zeros(0, np.uint32)
        self.rows += doc_ids
        self.a += [i if ok else none for i, ok in zip(sides[0], good)]
        self.b += [i if ok else none for i, ok in zip(sides[1], good)]
        self.size += sum(map(len, bodies))

    def batches(self, number: int, left: Coder, right: Coder) -> Iterator[pa.RecordBatch]:
        """One row per document, then one row with the chunk's distinct pairs of linked ids."""
        ids_a, _, ends_a = _entries(left, self.a)
        ids_b, _, ends_b = _entries(right, self.b)
        group_a, group_b = groups_of(ends_a, ends_b)
        text, group_ends = _written(ids_a, ids_b, group_a, group_b, _digits_of(max(len(left.entries), len(right.entries))))
        n_a = np.array([len(x) for x in self.a], np.int64)
        n_b = np.array([len(x) for x in self.b], np.int64)
        stop_a = np.cumsum(n_a)
        doc_end = np.concatenate([[0], ends_a])[stop_a]  # byte end of each document
        groups = np.concatenate([[0], np.concatenate([[0], group_a + 1])[stop_a]])  # groups up to each document
        to = np.concatenate([[0], group_ends])[groups]
        digests = [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(to[:-1], to[1:])]

        in_a, in_b, link_ends = _links(ends_a, ends_b)
        n_links = np.diff(np.concatenate([[0], np.searchsorted(link_ends, doc_end, "right")]))
        linked = ids_a[in_a].astype(np.uint64) << np.uint64(32) | ids_b[in_b]
        pairs = np.sort(linked)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        doc = np.repeat(np.arange(len(n_links)), n_links)
        held = np.sort(doc * max(len(pairs), 1) + np.searchsorted(pairs, linked))
        first = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
        held, times = held[first], np.diff(first, append=len(held))
        holder, held = np.divmod(held, max(len(pairs), 1))
        stops = np.searchsorted(holder, np.arange(len(n_links) + 1))
        packed = []
        for x, y in zip(stops[:-1], stops[1:]):
            # Steps between the pairs' numbers, and how often each is linked: small numbers that pack well.
            steps = np.diff(held[x:y], prepend=0).astype("<u4")
            packed.append(pa.compress(np.concatenate([steps, times[x:y].astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes(),
                                      "zstd", asbytes=True) if y > x else None)
        sizes = np.diff(stops)
        none = pa.nulls(len(self.rows), pa.list_(pa.int32()))
        fixed = [pa.array(self.rows, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(np.diff(groups)),
                 pa.array(n_links), pa.array(digests, pa.string()), pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary())]
        names = [*_DOCUMENT, "chunk", "ids_a", "ids_b", "holders"]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(len(self.rows), number, np.int64)), none, none, none], names)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (
            pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF), np.bincount(held, minlength=len(pairs)))]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, x.type) for x in fixed], pa.array([number], pa.int64()), *lists], names)


_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_held", "held"]

_ENCODED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_held int, "
            "held binary, chunk bigint, ids_a array<int>, ids_b array<int>, holders array<int>")

_ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
            "groups_sha256 string")


def _encode(sources, kinds: tuple[type, type], pattern: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = (_coder(kind, source, pattern) for kind, source in zip(kinds, sources.value))
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            first = 0
            while first < len(texts):
                some, size, last = [], 0, first
                while last < len(texts) and (not some or size < PART):  # a part's worth of texts at a time
                    some.append(texts[last].as_py() or "")
                    size += len(some[-1])
                    last += 1
                chunk.add(ids[first:last], some, left, right)
                first = last
                if chunk.size >= limit:
                    yield from chunk.batches(number, left, right)
                    number, chunk = number + 1, _Chunk()
        if chunk.rows:
            yield from chunk.batches(number, left, right)

    return run


def _sums(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of a chunk's documents, from the corpus-wide counts of its pairs."""
    size = pairs.num_rows
    count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    at = pairs["pair"].to_numpy()
    count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    totals = np.zeros((documents.num_rows, 2), np.int64)
    for row, (n, held) in enumerate(zip(documents["n_held"].to_pylist(), documents["held"])):
        if not n:
            continue
        raw = np.frombuffer(pa.decompress(held.as_py(), 8 * n, "zstd", asbytes=True), np.uint8)
        numbers = np.ascontiguousarray(raw.reshape(4, 2 * n).T).view("<u4").ravel().astype(np.int64)
        which, times = np.cumsum(numbers[:n]), numbers[n:]
        totals[row] = (best[which] * times).sum(), (count[which] * times).sum()
    columns = {name: documents[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": pa.array(totals[:, 0]), "count_sum": pa.array(totals[:, 1]),
                               "groups_sha256": documents["groups_sha256"]})


def align_tokenizers(docs: DataFrame, left: bytes, right: bytes, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", kinds: tuple[type, type] = (ByteLevel, Pieces),
                     chunk_bytes: int = CHUNK) -> DataFrame:
    """Alignment of the tokens of two tokenizers, one row per row of ``docs``.

    ``left`` and ``right`` are the contents of the tokenizers' files, read as ``kinds`` (the left side encodes a space
    and the text, the right side adds the space itself); ``pattern`` splits texts for a byte-level file. Returns
    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: tokens of either side, groups, links
    (pairs of overlapping tokens), links whose id pair is held by as many documents as any pair of the same left id
    (ties included), and the sum over the links of the number of documents that hold their id pair. Rows are
    documents: a repeated id or text counts again. Null and empty texts, and texts that a side's entries don't give
    back, have no tokens: zeros and an empty digest, and they hold no pair. Other columns are ignored.
    Texts over ``PART`` characters are encoded in parts; one without any lone space between other characters stays whole.
    """
    spark = docs.sparkSession
    # A tokenizer file has a fixed size, whatever the texts.
    sources = spark.sparkContext.broadcast((left, right))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = materialize(texts.mapInArrow(_encode(sources, kinds, pattern, chunk_bytes), _ENCODED), "aligned")
    documents = encoded.where("ids_a IS NULL").select("chunk", *_DOCUMENT)
    pairs = encoded.where("ids_a IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("ids_a", "ids_b", "holders"))).select(
        "chunk", F.col("pos").alias("pair"), "col.ids_a", "col.ids_b", "col.holders")
    counts = materialize(pairs.groupBy("ids_a", "ids_b").agg(F.sum("holders").alias("count")), "pair-counts")
    # One row per left id: at most as many as its vocabulary.
    highest = counts.groupBy("ids_a").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "ids_a").select(
        "ids_a", "ids_b", "count", (F.col("count") == F.col("highest")).alias("best"))
    counted = pairs.join(counts, ["ids_a", "ids_b"]).select(F.col("chunk").alias("of"), "pair", "count", "best")
    return documents.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(_sums, _ALIGNED)

"""Removal of long repeated strings by column-wise construction of a collection's suffix order.

Equal 200-byte strings are brought together first: the least hash of the 64-byte strings inside a
window, its anchor, is the same wherever the window stands. Neighbouring windows with one anchor make
one piece of text, and only pieces whose anchor stands in two places are looked at further. Equal
pieces become one, with a multiplicity.

The pieces of an anchor are one collection of strings. Its Burrows-Wheeler transform and longest common
prefixes are built from the last column to the first: every round inserts one symbol per string, reading the
columns so far from a sequential file and writing the next ones. A window is repeated if the
suffix that starts with it has 200 bytes in common with a neighbour in suffix order, or if its
piece stands in several places. A collection of one string with a multiplicity needs no construction.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrow import flat, mixed, powers, text_chunks
from driftline.session import discard, materialize

#: Bytes of a string that counts as repeated, and of an anchor inside it.
LENGTH, ANCHOR = 200, 64

#: Symbols of the collections that a task builds together; more no longer fit a processor's cache.
SYMBOLS = 1 << 18

#: Distinct pieces of an anchor that are one collection. Beyond, windows are compared by their digests.
COLLECTION = 2048

#: Bytes of a column that a task keeps in memory from round to round; a larger one is a file.
HELD = 1 << 20

_CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``span`` neighbouring values, by doubling."""
    wide = 1
    while wide * 2 <= span:
        values = pick(values[:-wide], values[wide:])
        wide *= 2
    rest = span - wide
    return pick(values[:-rest], values[rest:]) if rest else values


def pieces(body: np.ndarray, at: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Row, start in the row, windows, anchor and places of each piece, in order; every window is in one piece.

    ``places`` is 2 if the anchor may stand twice in the piece, else 1.
    """
    none = (np.zeros(0, np.int64),) * 5
    if len(body) < length:
        return none
    prefix = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body), _BASE), out=prefix[1:])
    hashes = mixed((prefix[anchor:] - prefix[:-anchor]) * powers(len(body) - anchor + 1, pow(_BASE, -1, 1 << 64)))
    span = length - anchor + 1
    values = _sliding(hashes, span, np.minimum)
    # A place is an anchor if no window over it has only larger ones, that is if the largest least is its own.
    padding = np.zeros(span - 1, np.uint64)
    anchors = np.flatnonzero(_sliding(np.concatenate([padding, values, padding]), span, np.maximum) == hashes)
    near = (hashes[anchors[1:]] == hashes[anchors[:-1]]) & (np.diff(anchors) < span)
    twins = np.zeros(len(hashes) + 1, np.int32)
    twins[anchors[1:][near] + 1] = 1
    twins = np.cumsum(twins)
    start = np.arange(len(values))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(values)]
    kept = start + length <= at[row + 1]
    start, row, values = start[kept], row[kept], values[kept]
    if not len(start):
        return none
    fresh = np.ones(len(start), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(start)))
    # Cut runs into pieces of at most ``span`` windows.
    parts = -(-size // span)
    run = np.repeat(np.arange(len(first)), parts)
    turn = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[run] + turn * span
    count = np.minimum(span, size[run] - turn * span)
    places = 1 + (twins[start[begin] + count + span - 1] > twins[start[begin]])
    return row[begin], start[begin] - at[row[begin]], count, values[begin].view(np.int64), places


class _File:
    """A column, read and written from front to back: on disk if it takes more than HELD bytes. It goes with its task."""

    def __init__(self, kind) -> None:
        self.kind, self.rows = kind, 0
        self.held: np.ndarray | None = None
        self.now = self.next = None

    def read(self) -> np.ndarray:
        """The column, not to be changed."""
        if self.held is not None:
            return self.held
        column = np.empty(self.rows, self.kind)
        self.now.seek(0)
        self.now.readinto(column.view(np.uint8))
        return column

    def write(self, column: np.ndarray) -> None:
        """Columns only grow, so the one before the last is written over."""
        column = column.astype(self.kind, copy=False)
        self.rows = len(column)
        if column.nbytes <= HELD:
            self.held = column
            return
        if self.now is None:
            self.held, self.now, self.next = None, tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.next.seek(0)
        self.next.write(column.data)
        self.now, self.next = self.next, self.now

    def close(self) -> None:
        for file in (self.now, self.next):
            if file is not None:
                file.close()


def _same_symbol(bwt: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``rows``: its place among all rows by symbol, and the next row before and after it with its symbol, else -1.

    Only runs of equal symbols are sorted; the transform of strings that are much alike has few.
    """
    edges = np.flatnonzero(bwt[1:] != bwt[:-1])
    starts = np.zeros(len(edges) + 1, np.int64)
    starts[1:] = edges + 1
    sizes = np.empty(len(starts), np.int64)
    np.subtract(edges, starts[:-1] - 1, out=sizes[:-1])
    sizes[-1] = len(bwt) - starts[-1]
    heads = bwt[starts]
    order = np.argsort(heads, kind="stable")
    turn = np.empty(len(order), np.int32)
    turn[order] = np.arange(len(order), dtype=np.int32)
    ends = np.cumsum(sizes[order])
    run = np.searchsorted(starts, rows, "right") - 1
    inside, turn = rows - starts[run], turn[run]
    earlier, later = order[turn - 1], order[np.minimum(turn + 1, len(order) - 1)]
    before = np.where((turn > 0) & (heads[earlier] == heads[run]), starts[earlier] + sizes[earlier] - 1, -1)
    after = np.where((turn + 1 < len(order)) & (heads[later] == heads[run]), starts[later], -1)
    return (ends[turn] - sizes[run] + inside, np.where(inside > 0, rows - 1, before),
            np.where(inside + 1 < sizes[run], rows + 1, after))


def suffix_order(body: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0: a string's start, else its symbol's number) and common prefixes of a collection.

    Rows 0..m-1 are the empty suffixes in the order of the strings, whose ends are all different. Column r
    holds the suffixes of length r: a suffix c + s comes after all suffixes with smaller first symbols and
    those c + t with t before s, so a count of c up to the row of s places it. Its common prefix with a
    neighbour c + t is one more than the least between the rows of t and s.
    """
    m, sizes = len(edges) - 1, np.diff(edges)
    codes = np.unique(body, return_inverse=True)[1].astype(np.uint8) + np.uint8(1)
    bwt_file, lcp_file = _File(np.uint8), _File(np.uint16)
    bwt_file.write(np.where(sizes > 0, codes[np.maximum(edges[1:] - 1, 0)] if len(codes) else 0, 0))
    lcp_file.write(np.zeros(m + 1, np.uint16))  # with a zero behind the last row
    # Strings that go on, in the order of the rows of their suffixes so far.
    live = rows = np.flatnonzero(sizes > 0)
    length = 0
    try:
        while len(live):
            bwt, lcp = bwt_file.read(), lcp_file.read()
            size, count = len(bwt), len(live)
            at, before, after = _same_symbol(bwt, rows)
            # New suffixes come in the order of the live rows among all rows by symbol.
            which = np.argsort(at)
            has_before, has_after = before >= 0, after >= 0
            # The least from behind the neighbour before up to the row, and from there up to the neighbour after; what
            # a row without such a neighbour gets isn't used.
            cuts = np.empty(3 * count, np.int64)
            cuts[0::3] = np.where(has_before, before, rows - 1) + 1
            cuts[1::3] = rows + 1
            cuts[2::3] = np.where(has_after, after, rows) + 1
            lows = np.minimum.reduceat(lcp, cuts)
            own = np.where(has_before, lows[0::3] + np.uint16(1), np.uint16(0))[which]
            below = np.where(has_after, lows[1::3] + np.uint16(1), np.uint16(0))[which]
            goes = at[which] + count  # there are m empty suffixes, and m - count rows are a string's start
            live = live[which]
            length += 1
            # What stands before the new suffix.
            goes_on = sizes[live] > length
            fresh = np.where(goes_on, codes[np.maximum(edges[live + 1] - 1 - length, 0)], np.uint8(0))
            old = np.ones(size + count + 1, bool)
            old[goes] = False
            wider_bwt, wider_lcp = np.empty(size + count, np.uint8), np.empty(size + count + 1, np.uint16)
            wider_bwt[old[:-1]], wider_lcp[old] = bwt, lcp
            wider_bwt[goes], wider_lcp[goes] = fresh, own
            follows = np.flatnonzero(old[goes + 1])  # a new suffix has its own value
            wider_lcp[goes[follows] + 1] = below[follows]
            wider_lcp[-1] = 0
            bwt_file.write(wider_bwt)
            lcp_file.write(wider_lcp)
            live, rows = live[goes_on], goes[goes_on]
        return bwt_file.read(), lcp_file.read()[:-1]
    finally:
        bwt_file.close()
        lcp_file.close()


def _sharing(body: np.ndarray, edges: np.ndarray, span: int) -> np.ndarray:
    """For each string whether any ``span`` bytes of it may stand anywhere else in the collection."""
    out = np.zeros(len(edges) - 1, bool)
    if len(body) < span:
        return out
    prefix = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body), _BASE), out=prefix[1:])
    hashes = mixed((prefix[span:] - prefix[:-span]) * powers(len(body) - span + 1, pow(_BASE, -1, 1 << 64)))
    owner = np.repeat(np.arange(len(out), dtype=np.int32), np.diff(edges))
    inside = owner[:len(hashes)] == owner[span - 1:]
    hashes, owner = hashes[inside], owner[:len(inside)][inside]
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    twin = hashes[1:] == hashes[:-1]
    out[owner[1:][twin]] = True
    out[owner[:-1][twin]] = True
    return out


def repeated_windows(body: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte of a collection whether the window that starts there stands anywhere else in it.

    A string that has no nine tenths of a window in common with any place of the collection isn't placed.
    """
    kept = _sharing(body, edges, max(1, length * 9 // 10))
    if not kept.all():
        inside, out = np.repeat(kept, np.diff(edges)), np.zeros(len(body), bool)
        out[inside] = _placed_windows(body[inside], np.concatenate([[0], np.cumsum(np.diff(edges)[kept])]), length)
        return out
    return _placed_windows(body, edges, length)


def _placed_windows(body: np.ndarray, edges: np.ndarray, length: int) -> np.ndarray:
    """The repeated windows by the order of all suffixes."""
    bwt, lcp = suffix_order(body, edges)
    m, sizes = len(edges) - 1, np.diff(edges)
    long = lcp >= length
    long[:-1] |= lcp[1:] >= length
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(bwt), np.int64)
    place[order] = np.arange(len(bwt))
    ends = int(np.count_nonzero(bwt == 0))
    out = np.zeros(len(body), bool)
    live, rows = np.arange(m), np.arange(m)
    for size in range(1, int(sizes.max(initial=0)) + 1):
        kept = sizes[live] >= size
        live, rows = live[kept], m + place[rows[kept]] - ends
        if size >= length:
            out[edges[live + 1] - size] = long[rows]
    return out


def _spans(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and end of each run of set windows, counted from the string's start."""
    padded = np.zeros(len(flags) + 1, bool)
    padded[:-1] = flags
    padded[edges[1:] - 1] = False  # a string's last byte starts no window, so runs end with it
    turn = np.flatnonzero(np.diff(np.concatenate([[False], padded])))
    first, end = turn[0::2], turn[1::2]
    owner = np.searchsorted(edges, first, "right") - 1
    return owner, first - edges[owner], end - edges[owner]


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = min(ANCHOR, max(1, length // 2))
        for batch in batches:
            for first, _, body, at in text_chunks(batch.column("text"), _CHUNK):
                row, start, count, value, places = pieces(body, at, length, anchor)
                if len(row):
                    took = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(took), batch.column("print").take(took), pa.array(start, pa.int32()),
                         pa.array(count, pa.int32()), pa.array(value), pa.array(places, pa.int32())],
                        ["doc_id", "print", "start", "count", "anchor", "places"])

    return run


def _cut(length: int):
    """The pieces of a text: where each stands, its digest, and its bytes once per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = flat(batch.column("text"))
            lists = batch.column("pieces")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            held = lists.flatten()
            start, count = np.asarray(held.field("start"), np.int64), np.asarray(held.field("count"), np.int64)
            begin = at[owner] + start
            view = memoryview(np.ascontiguousarray(body))
            seen: set[bytes] = set()
            digests, strings = [], []
            for a, n in zip(begin.tolist(), count.tolist(), strict=True):
                string = view[a:a + n + length - 1]
                digest = hashlib.blake2b(string, digest_size=16).digest()
                digests.append(digest)
                strings.append(None if digest in seen else bytes(string))
                seen.add(digest)
            took = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(took), batch.column("print").take(took), held.field("start"), held.field("count"),
                 held.field("anchor"), pa.array(digests, pa.binary()), pa.array(strings, pa.binary())],
                ["doc_id", "print", "start", "count", "anchor", "digest", "string"])

    return run


_FOUND = "digest binary, first int, end int"


def _build(length: int):
    """Repeated windows of the pieces, whole anchors at a time. Rows come sorted by anchor."""
    def collections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        digests: list[bytes] = []
        strings: list[bytes] = []
        copies: list[int] = []
        size, last = 0, None
        for batch in batches:
            for anchor, digest, string, n in zip(*[batch.column(c).to_pylist() for c in ("anchor", "digest", "string", "n")],
                                                 strict=True):
                if size >= SYMBOLS and anchor != last:
                    yield digests, strings, copies
                    digests, strings, copies, size = [], [], [], 0
                digests.append(digest)
                strings.append(string)
                copies.append(n)
                size, last = size + len(string), anchor
        if digests:
            yield digests, strings, copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, strings, copies in collections(batches):
            sizes = np.array([len(s) for s in strings])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            flags = repeated_windows(np.frombuffer(b"".join(strings), np.uint8), edges, length)
            for i in np.flatnonzero(np.array(copies) > 1).tolist():
                flags[edges[i]:edges[i + 1] - length + 1] = True
            owner, first, end = _spans(flags, edges)
            names = pa.array(digests, pa.binary())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
                                             ["digest", "first", "end"])

    return run


def _windows(length: int):
    """The digest of every window of a piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, string, n in zip(*[batch.column(c).to_pylist() for c in ("digest", "string", "n")], strict=True):
                marks = [hashlib.blake2b(string[k:k + length], digest_size=16).digest() for k in range(len(string) - length + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.binary()), pa.array([digest] * len(marks), pa.binary()),
                     pa.array(range(len(marks)), pa.int32()), pa.array([n] * len(marks), pa.int64())],
                    ["mark", "digest", "first", "n"])

    return run


def _finish(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, hashes, texts = [], [], [], [], []
            spans = batch.column("spans")
            for i, text in enumerate(batch.column("text")):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                for span in sorted((s["first"], s["end"] + length - 1) for s in spans[i].as_py() or ()):
                    if runs and span[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], span[1])
                    else:
                        runs.append(list(span))
                kept, at = [], 0
                for first, end in runs:
                    kept.append(body[at:first])
                    at = end
                left = b"".join([*kept, body[at:]])
                n_bytes.append(len(body))
                n_removed.append(len(body) - len(left))
                n_spans.append(len(runs))
                hashes.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    texts.append(left)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                       pa.array(n_spans, pa.int64()), pa.array(hashes, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   keep_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]`` per row of ``docs``.

    Removes every byte covered by a string of ``length`` bytes that starts in more than one place of all
    texts (UTF-8), the same text included; strings never cross texts. ``kept`` holds the remaining bytes,
    which may end inside a character. Null is empty; a repeated row repeats all its strings; null ids are
    kept apart by their text. Other columns are ignored; an empty table gives no rows.
    """
    # A row is found again by its id and a fingerprint of its text; equal rows share what is found.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("print", F.xxhash64("text", F.length("text")))
    kind = texts.schema["doc_id"].dataType.simpleString()
    place = f"doc_id {kind}, print bigint, start int, count int, anchor bigint"
    row = ["doc_id", "print"]

    found = materialize(texts.where(F.octet_length("text") >= length).mapInArrow(_scan(length), f"{place}, places int"), "anchors")
    twice = found.groupBy("anchor").agg(F.sum("places").alias("places")).where("places > 1").select("anchor")
    wanted = found.join(twice, "anchor", "left_semi").groupBy(*row).agg(
        F.collect_set(F.struct("start", "count", "anchor")).alias("pieces"))
    wanted = wanted.toDF("w_id", "w_print", "pieces")
    cut = materialize(
        texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["w_id"]) & (texts["print"] == wanted["w_print"]))
        .select("doc_id", "print", "text", "pieces").mapInArrow(_cut(length), f"{place}, digest binary, string binary"), "pieces", free_shuffle=True)
    discard(found)

    strings = materialize(cut.groupBy("anchor", "digest").agg(F.max("string").alias("string"), F.count(F.lit(1)).alias("n")),
                          "strings", free_shuffle=True)
    sized = strings.join(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct")), "anchor")
    # The only string of its collection, with several copies: each of its windows is repeated.
    alone = (F.col("distinct") == 1) & (F.col("n") > 1)
    whole = sized.where(alone).select("digest", F.lit(0).alias("first"), (F.octet_length("string") - (length - 1)).alias("end"))
    crowded = sized.where(F.col("distinct") > COLLECTION)
    built = sized.where(~alone & (F.col("distinct") <= COLLECTION)).repartition("anchor") \
        .sortWithinPartitions("anchor", "digest").mapInArrow(_build(length), _FOUND)
    # A crowd of pieces around one anchor: its windows are spread by their own digests.
    windows = crowded.mapInArrow(_windows(length), "mark binary, digest binary, first int, n bigint")
    marks = windows.groupBy("mark").agg(F.sum("n").alias("places")).where("places > 1").select("mark")
    told = windows.join(marks, "mark", "left_semi").select("digest", "first", (F.col("first") + 1).alias("end"))
    spans = materialize(built.union(told).union(whole), "repeats", free_shuffle=True)
    discard(strings)

    runs = cut.select(*row, "start", "digest").join(spans, "digest").select(
        *row, (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end"))
    per_row = runs.groupBy(*row).agg(F.collect_set(F.struct("first", "end")).alias("spans")).toDF("r_id", "r_print", "spans")
    joined = texts.join(per_row, texts["doc_id"].eqNullSafe(per_row["r_id"]) & (texts["print"] == per_row["r_print"]), "left")
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _finish(length, keep_text), schema + (", kept binary" if keep_text else ""))

"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of documents inside one task. Its words become symbols (a benchmark word's number,
or none: such a word can't take part in a match, and a run of benchmark words shorter than the
shortest phrase can't hold one, so both only separate). The symbols get a suffix array, from which
the Burrows-Wheeler transform goes into a wavelet matrix. All phrases are searched backward together
through its ranks; suffix positions are sampled, and occurrences are located by walking to a sample.
No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.arrow import LOWER, span_hashes, text_chunks, word_spans

#: Words of a phrase. An item with fewer words is one phrase.
WINDOW = 10

#: Characters of benchmark text searched in one pass; more items take more passes.
BLOCK_CHARS = 16 << 20

#: Bytes of a shard, and every how many suffix positions are kept.
SHARD_BYTES, SAMPLE = 16 << 20, 8

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


class Phrases:
    """The distinct windows of a block of items: symbols per word, windows as symbol rows, and their items."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        texts = pa.array([t or "" for _, t in rows], pa.string())
        hashed: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(rows)
        for first, last, body, at in text_chunks(texts):
            body = LOWER[body]
            starts, ends, owner = word_spans(body, at, IS_WORD)
            values = span_hashes(body, starts, ends)
            cut = np.searchsorted(owner, np.arange(last - first + 1))
            for i in range(last - first):
                hashed[first + i] = values[cut[i]:cut[i + 1]]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.items = sorted({i for i, _ in rows})
        number = {item: k for k, item in enumerate(self.items)}
        windows: dict[tuple[int, ...], set[int]] = {}
        for (item, _), words in zip(rows, hashed, strict=True):
            symbols = (np.searchsorted(self.vocabulary, words) + 1).tolist()
            for k in range(max(1, len(symbols) - WINDOW + 1) if symbols else 0):
                windows.setdefault(tuple(symbols[k:k + WINDOW]), set()).add(number[item])
        self.length = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), WINDOW), np.int64)
        for k, window in enumerate(windows):
            self.symbols[k, :len(window)] = window
        owners = [sorted(x) for x in windows.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([k for x in owners for k in x], np.int64)

    def encode(self, values: np.ndarray) -> np.ndarray:
        """The symbol of each word hash, 0 outside the benchmark."""
        at = np.searchsorted(self.vocabulary, values)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == values, at + 1, 0) if len(self.vocabulary) else np.zeros(len(values), np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, by doubling. The last symbol must be smaller than all others."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size, width = len(text), 1
    while True:
        following = np.zeros(size, np.int64)
        following[:-width] = rank[width:] + 1 if width < size else 0
        key = rank * (size + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(size, np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(size, np.int64)
        rank[order] = fresh
        if fresh[-1] == size - 1:
            return order
        width *= 2


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).tobytes(), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.size, self.ones = len(bits), int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Backward search and located occurrences over a sequence of symbols that ends in its only smallest one."""

    def __init__(self, text: np.ndarray) -> None:
        order = suffix_array(text)
        last = text[order - 1]  # the transform; the first suffix wraps to the end
        self.levels: list[Bits] = []
        self.width = max(1, int(text.max()).bit_length())
        left = last
        for level in range(self.width - 1, -1, -1):
            bit = (left >> level) & 1 == 1
            self.levels.append(Bits(bit))
            left = np.concatenate([left[~bit], left[bit]])
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.width))]).astype(np.int64)
        marked = order % SAMPLE == 0
        self.marks, self.samples, self.size = Bits(marked), order[marked], len(text)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        first = np.zeros(len(at), np.int64)
        for level, bits in zip(range(self.width - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> level) & 1 == 1
            ones_first, ones_at = bits.rank(first), bits.rank(at)
            zeros = bits.size - bits.ones
            first = np.where(one, zeros + ones_first, first - ones_first)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - first

    def symbol(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for bits in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            value = value * 2 + one
            at = np.where(one, bits.size - bits.ones + ones, at - ones)
        return value

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase, from its last symbol to its first."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.size, np.int64)
        for step in range(symbols.shape[1]):
            live = np.flatnonzero((step < length) & (low < high))
            if not len(live):
                break
            symbol = symbols[live, length[live] - 1 - step]
            known = symbol < len(self.smaller) - 1
            base = self.smaller[np.where(known, symbol, 0)]
            low[live] = np.where(known, base + self.rank(symbol, low[live]), 0)
            high[live] = np.where(known, base + self.rank(symbol, high[live]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix: steps back to the next sample, plus the sample."""
        place, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            found = self.marks.get(here)
            at = open_[found]
            place[at] = self.samples[self.marks.rank(rows[at])] + walked[at]
            open_ = open_[~found]
            here = rows[open_]
            symbol = self.symbol(here)
            rows[open_] = self.smaller[symbol] + self.rank(symbol, here)
            walked[open_] += 1
        return place


def occurrences(symbols: np.ndarray, docs: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word place, phrase) of every occurrence in the words of a shard; ``docs`` is each word's row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.length) or not len(symbols):
        return none
    inside = symbols > 0
    breaks = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (docs[1:] != docs[:-1])]))
    length = np.diff(np.concatenate([breaks, [len(symbols)]]))
    kept = inside[breaks] & (length >= phrases.length.min())
    starts, length = breaks[kept], length[kept]
    if not len(starts):
        return none
    # Runs one after the other, a separator (1) after each and the end (0) last; symbols move up by one.
    goes = np.cumsum(length + 1) - length - 1
    text = np.ones(int(goes[-1] + length[-1]) + 2, np.int64)
    text[-1] = 0
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    source = np.repeat(starts, length) + within
    target = np.repeat(goes, length) + within
    text[target] = symbols[source] + 1
    back = np.zeros(len(text), np.int64)
    back[target] = source

    index = FMIndex(text)
    low, high = index.search(phrases.symbols + 1, phrases.length)
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    return back[index.locate(rows)], phrase


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first word, end word, start byte, end byte) joined where they overlap or touch."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], span[1]), last[2], max(last[3], span[3]))
        else:
            out.append(span)
    return out


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def _search(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = broadcast.value
        for batch in batches:
            texts = batch.column("text")
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for first, last, body, at in text_chunks(texts, SHARD_BYTES):
                body = LOWER[body]
                starts, ends, owner = word_spans(body, at, IS_WORD)
                n_words[first:last] = np.bincount(owner, minlength=last - first)
                places, phrase = occurrences(phrases.encode(span_hashes(body, starts, ends)), owner, phrases)
                if not len(places):
                    continue
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + phrases.length[phrase], -1)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                fresh = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
                word0 = np.searchsorted(owner, owner)  # the first word of each word's row
                for a, b in zip(hit[fresh].tolist(), hit[np.concatenate([fresh[1:], [len(hit)]]) - 1].tolist(), strict=True):
                    row, base = int(owner[a]), int(word0[a])
                    spans[first + row].append({"first": a - base, "end": b + 1 - base,
                                               "start_byte": int(starts[a] - at[row]), "end_byte": int(ends[b] - at[row])})
                n = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase]
                which = np.repeat(phrases.owner_at[phrase], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.unique(np.repeat(owner[places], n) * len(phrases.items) + phrases.owners[which])
                for row, item in zip((pairs // len(phrases.items)).tolist(), (pairs % len(phrases.items)).tolist(), strict=True):
                    items[first + row].append(phrases.items[item])
            for row, found in enumerate(spans):
                if len(found) > 1:
                    spans[row] = [dict(zip(("first", "end", "start_byte", "end_byte"), s, strict=True))
                                  for s in merged([tuple(f.values()) for f in found])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), texts, pa.array(n_words), pa.array(spans, pa.list_(_SPAN)),
                 pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, text, n_words, spans, items`` per row of ``docs``.

    ``spans`` are the merged runs of words inside any occurrence of a benchmark window, as word numbers
    and as UTF-8 byte offsets; ``items`` are the distinct ids, as text, of the items that occur. Null texts
    are empty and have no words; an item without words, or an empty benchmark, matches nothing; a null
    item id is ``null``; repeated documents and items are each looked at. Other columns are ignored.

    The benchmark is broadcast in blocks of about ``block_chars`` characters (one longer item is a block
    of its own), each searched in all documents in a pass of its own.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    schema = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    span = "struct<first: bigint, end: bigint, start_byte: bigint, end_byte: bigint>"
    found = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{span}>").alias("spans"),
        F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        phrases = Phrases([(r["item"], r["text"]) for r in part.collect()])
        found = found.mapInArrow(_search(spark.sparkContext.broadcast(phrases)),
                                 f"doc_id {schema}, text string, n_words bigint, spans array<{span}>, items array<string>")
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``."""
    found = find_benchmark(docs, benchmark, id_col, text_col)
    listed = F.sort_array(F.array_distinct("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), listed.alias("listed")).select(
        "doc_id", "n_words", "n_hit", F.size("listed").cast("long").alias("n_items"),
        F.sha2(F.array_join("listed", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

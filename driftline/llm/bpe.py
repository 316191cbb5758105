"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

A task splits its texts into pieces. Pieces that are tokens themselves are looked up; the other
distinct ones become rows of (piece, position, token). A recursive query joins neighbours with the
merge table and contracts, in every piece at once, the leftmost pair of least rank and those that
nothing can come before, until no piece has a pair that merges. Ordered aggregation gives each
piece's ids and, from them, its decoded bytes.
A text is the concatenation of its pieces. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import closing

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the encoded pieces and parts that a task remembers before it starts anew, and what Python takes for a piece
#: besides its text, ids and decoded bytes.
REMEMBERED_BYTES, ENTRY_BYTES = 128 << 20, 400

#: Bytes of new pieces encoded by one query (one longer piece is a query of its own).
QUERY_BYTES = 1 << 20

#: The pattern under which a lone space always starts a piece: each class of its pieces may have one in front.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters and marks of most parts; what has others is cut by the pattern. An apostrophe may start a piece of its own.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
MARKS = r"!-&(-/:-@\x5B-\x60{-~"

#: ``pos`` is the byte's place among all pieces, with a place left free after each piece, so that tokens of
#: two pieces are never neighbours; ``prev`` and ``next`` are the kinds of the bytes around a token. A round contracts a
#: piece's least pair and those that nothing can come before. The last select is one ordered aggregation for all pieces.
ENCODE = """
WITH RECURSIVE t(piece, pos, len, id, prev, next, done) AS (
  SELECT piece::INTEGER, pos::INTEGER, 1, id::INTEGER, prev::UBIGINT, next::UBIGINT, false FROM start
  UNION ALL
  SELECT * FROM (
    WITH live AS (SELECT piece, pos, len, id, prev, next FROM t WHERE NOT done),
    pair AS MATERIALIZED (
      SELECT a.piece, a.pos, a.len AS half, b.len AS rest, a.id = b.id AS twin, b.next, m.rank, m.alone,
             (m.before >> a.prev) & (m.behind >> b.next) & 1 = 1 AS safe
      FROM live a JOIN live b ON b.pos = a.pos + a.len JOIN merges m ON m.both = a.id * 4294967296::BIGINT + b.id),
    best AS MATERIALIZED (SELECT piece, min(rank * 4294967296 + pos) AS least FROM pair GROUP BY piece),
    ripe AS MATERIALIZED (
      SELECT pair.*, (best.least >> 32) = pair.rank AS first, pair.pos = (best.least & 4294967295) AS leftmost
      FROM pair JOIN best ON best.piece = pair.piece AND (pair.safe OR (best.least >> 32) = pair.rank)),
    picked AS (
      SELECT pos, half, rest, rank, next FROM ripe
      WHERE CASE WHEN NOT first THEN true WHEN alone THEN leftmost ELSE NOT twin END
      UNION ALL  -- overlapping equal pairs (aaaa): every other one of a chain, from the left
      SELECT pos, half, rest, rank, next FROM (
        SELECT *, row_number() OVER (PARTITION BY piece, chain ORDER BY pos) AS n FROM (
          SELECT *, pos - half * row_number() OVER (PARTITION BY piece ORDER BY pos) AS chain
          FROM ripe WHERE first AND twin AND NOT alone)) WHERE n % 2 = 1),
    change AS (SELECT pos, half + rest AS len, rank, next FROM picked UNION ALL SELECT pos + half, 0, 0, 0 FROM picked)
    SELECT live.piece, live.pos, coalesce(change.len, live.len) AS len, coalesce(change.rank, live.id) AS id,
           live.prev, coalesce(change.next, live.next) AS next, best.piece IS NULL AS done
    FROM live LEFT JOIN change ON change.pos = live.pos LEFT JOIN best ON best.piece = live.piece
    WHERE change.len IS NULL OR change.len > 0)
)
SELECT list(piece ORDER BY pos), list(id ORDER BY pos), string_agg(v.hex, '' ORDER BY pos)
FROM t JOIN vocabulary v USING (id) WHERE done"""


#: Kinds of the bytes beside a token: the byte modulo this, and this for none.
NONE = 63


class Vocabulary:
    """The ranks of a tokenizer and the merges that they imply."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        left, right, rank = [], [], []
        for token, number in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(number)
        self.left, self.right, self.rank = (np.array(x, np.int64) for x in (left, right, rank))
        # A merge that could make a pair of a smaller rank with its neighbour goes alone; of all others,
        # each place of a piece can be contracted in the same round without changing the outcome.
        size = max(ranks.values(), default=0) + 1
        least = np.full(size, size, np.int64)
        np.minimum.at(least, self.left, self.rank)
        np.minimum.at(least, self.right, self.rank)
        self.alone = least[self.rank] < self.rank
        # What follows a token starts with the next byte, however it is contracted. A merge is safe between two bytes
        # if neither of its tokens can go with a neighbour at its rank or before: it is made in any case.
        tokens = {number: token for token, number in ranks.items()}
        last = np.array([tokens[i][-1] for i in left], np.int64)
        first = np.array([tokens[i][0] for i in right], np.int64)
        self.before = self._safe(self.right, last, self.left, size)
        self.behind = self._safe(self.left, first, self.right, size)

    def _safe(self, taken: np.ndarray, byte: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
        """Bits of each merge: whether it is safe beside each kind of byte, and (the last bit) beside none.

        Each merge would also take the token ``taken`` with a neighbour that touches it with ``byte``; ``own`` is the
        token that a merge itself has there.
        """
        least = np.full((size, NONE + 1), size, np.int32)
        np.minimum.at(least, (taken, byte % NONE), self.rank)
        out = np.zeros(len(own), np.uint64)
        for kind in range(NONE + 1):
            out |= (least[own, kind] > self.rank).astype(np.uint64) << np.uint64(kind)
        out[self.alone] = 0
        return out

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)


class Encoder:
    """Encodes pieces inside one task. ``known`` holds ids as little-endian bytes, and the decoded bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ranks = vocabulary.ranks
        self.tokens = {rank: token for token, rank in vocabulary.ranks.items()}
        self.find = regex.compile(vocabulary.pattern).findall
        white = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace()) + "]"
        self.beside = f"{white} | {white}|^ | $" if vocabulary.pattern == SPACED else ""  # the empty one is in every text
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.parts: dict[str, bytes] = {}  # the ids of a space and the part
        self.odd: dict[str, bytes] = {}
        self.held = 0
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        # Rules that only cost time on tables as small as these.
        self.con.execute("SET disabled_optimizers = 'join_filter_pushdown,late_materialization,statistics_propagation,"
                         "compressed_materialization'")
        merges = pa.table({"both": vocabulary.left * (1 << 32) + vocabulary.right, "rank": vocabulary.rank,
                           "alone": vocabulary.alone, "before": vocabulary.before, "behind": vocabulary.behind})
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()),
                           "hex": [t.hex() for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", tokens)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.length = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        self.length[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def close(self) -> None:
        """Give back what is remembered, and the tables."""
        self.con.close()
        self.known, self.parts, self.odd, self.held = {}, {}, {}, 0

    def contract(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each piece."""
        body = np.frombuffer(b"".join(pieces), np.uint8)
        number = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ids = self.bytes[body]
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        around = np.full(len(body) + len(pieces) + 1, NONE, np.uint8)  # a byte's place is its ``pos`` + 1
        pos = np.arange(len(body)) + number
        around[pos + 1] = body % NONE
        self.con.register("start", pa.table({"piece": number, "pos": pos, "id": ids, "prev": around[pos], "next": around[pos + 2]}))
        found = self.con.execute(ENCODE).fetchnumpy()
        self.con.unregister("start")
        owner, coded, hexed = (column[0] for column in found.values())
        decoded, coded = bytes.fromhex(hexed), np.asarray(coded).astype("<u4")
        edge = np.searchsorted(np.asarray(owner), np.arange(len(pieces) + 1))
        at = np.concatenate([[0], np.cumsum(self.length[coded])])[edge].tolist()
        coded = coded.tobytes()
        edge = (edge * 4).tolist()
        return [(coded[edge[i]:edge[i + 1]], decoded[at[i]:at[i + 1]]) for i in range(len(pieces))]

    def coded(self, pieces: set[str], out: dict[str, tuple[bytes, bytes]]) -> None:
        """Put the ids and decoded bytes of pieces into ``out``."""
        waiting: list[str] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            out.update(zip(waiting, self.contract(raw), strict=True))
            waiting.clear()
            raw.clear()

        ranks, tokens = self.ranks, self.tokens
        for piece in pieces:
            data = piece.encode()
            rank = ranks.get(data)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little"), tokens[rank]
                continue
            if waiting and size + len(data) > QUERY_BYTES:
                flush()
                size = 0
            waiting.append(piece)
            raw.append(data)
            size += len(data)
        if waiting:
            flush()

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces, and remember them."""
        found: dict[str, tuple[bytes, bytes]] = {}
        self.coded(pieces, found)
        self.remember(found)

    def remember(self, found: dict[str, tuple[bytes, bytes]]) -> None:
        self.known.update(found)
        self.held += ENTRY_BYTES * len(found) + sum([len(p) + len(c[0]) + len(c[1]) for p, c in found.items()])

    def keep(self, parts: dict[str, bytes], odd: dict[str, bytes]) -> None:
        """Remember parts by their ids; what they decode to only where it isn't the part itself."""
        self.parts.update(parts)
        self.odd.update(odd)
        self.held += ENTRY_BYTES // 2 * (len(parts) + len(odd)) + sum(map(len, parts)) + sum(
            map(len, parts.values())) + sum(map(len, odd.values()))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text.

        Where no white space stands next to a space, each space starts a piece, so a text is cut at its
        spaces and the parts, which texts share, are encoded once. The first part has no space before.
        """
        if self.held > REMEMBERED_BYTES:
            self.known, self.parts, self.odd, self.held = {}, {}, {}, 0
        plain = pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), self.beside)).to_pylist()
        heads = [text.partition(" ")[0] if p else text for text, p in zip(texts, plain, strict=True)]
        rests = [text[len(head) + 1:] if len(head) < len(text) else None for text, head in zip(texts, heads, strict=True)]
        cut = [self.find(head) for head in heads]
        self.learn({p for pieces in cut for p in pieces} - self.known.keys())
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        named = pc.dictionary_encode(split.flatten())
        body, size, odd = self.ids_of(named.dictionary)
        number = np.asarray(named.indices)
        ids = _joined(body, size, number)
        # The first of the parts and of the ids of each text.
        rows = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(split), 0)))])
        edge = np.concatenate([[0], np.cumsum(size[number])])[rows].tolist()
        out = []
        for i, (pieces, rest) in enumerate(zip(cut, rests, strict=True)):
            coded = [self.known[p] for p in pieces]
            decoded = [c[1] for c in coded]
            if odd:
                decoded += [odd[k] for k in number[rows[i]:rows[i + 1]].tolist()]
            elif rest is not None:
                decoded += [b" ", rest.encode()]
            out.append((b"".join([*[c[0] for c in coded], ids[edge[i]:edge[i + 1]].tobytes()]), b"".join(decoded)))
        return out

    def ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Ids of different parts, each with a space before it, and their numbers; and what the parts decode to if that
        isn't a space and the part for all of them.

        Most parts are a word, which is one piece with its space, and marks, which are another.
        """
        match = pc.extract_regex(parts, f"^(?P<word>[{LETTERS}]+)(?P<marks>[{MARKS}]*)$")
        word, marks = (pc.struct_field(match, name).dictionary_encode() for name in ("word", "marks"))
        words, tails = word.dictionary.to_pylist(), marks.dictionary.to_pylist()
        rest = parts.filter(match.is_null()).to_pylist()
        self.learn_parts([p for p in words if p not in self.parts], words=True)
        self.learn_parts([p for p in rest if p not in self.parts])
        self.learn({p for p in tails if p} - self.known.keys())
        last = [self.known[p] if p else (b"", b"") for p in tails]
        # Units are words, the rest, marks, and one that is empty.
        units = [*[self.parts[p] for p in words], *[self.parts[p] for p in rest], *[c[0] for c in last], b""]
        first = np.asarray(word.indices.fill_null(0)).copy()
        first[np.asarray(match.is_null())] = np.arange(len(words), len(words) + len(rest))
        second = np.asarray(marks.indices.fill_null(len(tails))) + len(words) + len(rest)
        order = np.stack([first, second], axis=1).ravel()
        size = np.fromiter(map(len, units), np.int64, len(units)) // 4
        body = _joined(np.frombuffer(b"".join(units), "<u4"), size, order)
        odd: list[bytes] = []
        if self.odd or any(c[1] != p.encode() for p, c in zip(tails, last, strict=True)):
            decoded = [*[self.odd.get(p) or b" " + p.encode() for p in [*words, *rest]], *[c[1] for c in last], b""]
            odd = [decoded[i] + decoded[j] for i, j in zip(first.tolist(), second.tolist(), strict=True)]
        return body, size[order].reshape(-1, 2).sum(axis=1), odd

    def learn_parts(self, parts: list[str], words: bool = False) -> None:
        """Encode and remember parts that aren't remembered yet, each with the space before it."""
        known, whole, odd = self.known, self.parts, self.odd
        cut = [[" " + part] for part in parts] if words else [self.find(" " + part) for part in parts]
        used = {p for pieces in cut for p in pieces}
        found = {p: known[p] for p in used & known.keys()}
        # A space and a word are one piece, and as a part they are remembered already.
        found |= {p: (whole[p[1:]], odd.get(p[1:]) or p.encode()) for p in used - found.keys() if p[:1] == " " and p[1:] in whole}
        fresh = used - found.keys()
        self.coded(fresh, found)
        ids: dict[str, bytes] = {}
        other: dict[str, bytes] = {}
        for part, pieces in zip(parts, cut, strict=True):
            if len(pieces) == 1:
                ids[part], decoded = found[pieces[0]]
                fresh.discard(pieces[0])  # the part stands for its only piece
            else:
                coded = [found[p] for p in pieces]
                ids[part], decoded = b"".join([c[0] for c in coded]), b"".join([c[1] for c in coded])
            if decoded != b" " + part.encode():
                other[part] = decoded
        self.keep(ids, other)
        self.remember({p: found[p] for p in fresh})


def _joined(body: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pieces of ``body``, of these sizes, one behind the other in this order."""
    shift = (np.cumsum(size) - size)[order]
    size = size[order]
    at = np.repeat(shift - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return body[at]


def _groups(texts: list[str | None], limit: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in groups of at most ``limit`` characters, or of one text."""
    group: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _run(broadcast, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of this task alone: a worker that went on to other work would still hold what an encoder remembers.
        with closing(Encoder(broadcast.value)) as encoder:
            for batch in batches:
                counts, ids, id_hashes, decoded_hashes = [], [], [], []
                for group in _groups(batch.column(1).to_pylist()):
                    for coded, decoded in encoder.encode(group):
                        counts.append(len(coded) // 4)
                        id_hashes.append(hashlib.sha256(coded).hexdigest())
                        decoded_hashes.append(hashlib.sha256(decoded).hexdigest())
                        if keep_ids:
                            ids.append(np.frombuffer(coded, "<u4").astype(np.int32))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                           pa.array(decoded_hashes, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]`` per row of ``docs``.

    ``path`` names a rank file, read on the driver; ``pattern`` splits texts into pieces. The hashes are
    of the ids as little-endian 32-bit integers and of the bytes they decode to. Null and empty texts
    have no tokens; repeated rows give repeated rows; other columns are ignored. The broadcast is the
    vocabulary, whose size doesn't depend on the documents.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(path, pattern)
    known = spark.sparkContext.broadcast(vocabulary)
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _run(known, keep_ids), schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of its ids in order. Null and empty ids decode to no bytes."""
    ranks = Vocabulary.read(path, "").ranks
    tokens = rows.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    @F.udf("binary")
    def joined(ids):
        return b"".join([tokens.value[i] for i in ids or ()])

    return rows.withColumn("decoded", joined(F.col(ids_col)))

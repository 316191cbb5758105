"""Token counts of a unigram vocabulary: a Viterbi pass that carries only score and count.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic
programming keeps, per position, the best score and the number of pieces on that path. Ties follow
the tokenizer: ends are filled in the order of the pieces' starts and only a strictly better
score replaces one, so of equal paths the one whose last piece starts first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space.
SPACE = "▁"

#: Below the lowest score by this much: a character that no piece covers. A fixed value of the tokenizer.
UNKNOWN_PENALTY = 10.0

#: Parts whose counts a Python worker remembers, by number and by characters, before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 32 << 20

#: Characters of text whose new parts go through the automaton together.
GROUP_CHARS = 4 << 20


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces that can match text, with their scores, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Counter:
    """Counts inside one task."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        # Texts are cut before every space mark that follows another character, unless a piece spans such a place.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.counts: dict[str, int] = {}
        self.held = 0

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation; a character that no piece covers counts its bytes."""
        size = len(text)
        # By start: the pieces that start there, shortest first.
        starting: list[list[tuple[int, float]] | None] = [None] * size
        for last, (length, score) in self.automaton.iter(text):
            start = last - length + 1
            if starting[start] is None:
                starting[start] = [(length, score)]
            else:
                starting[start].append((length, score))
        worst = float("-inf")
        best, count = [worst] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        unknown = self.unknown
        for start in range(size):
            here, so_far = best[start], count[start] + 1
            single = False
            for length, score in starting[start] or ():
                end = start + length
                single = single or length == 1
                if here + score > best[end]:
                    best[end], count[end] = here + score, so_far
            if not single and here + unknown > best[start + 1]:
                best[start + 1], count[start + 1] = here + unknown, count[start] + len(text[start].encode())
        return count[size]

    def _parts(self, text: str) -> list[str]:
        if not self.cuts or SPACE in text:
            return [text.replace(" ", SPACE)]
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        # A run of spaces goes with the word after it.
        parts, waiting = [], ""
        for k, part in enumerate(text.split(" ")):
            if part or k == 0 and not text.startswith(" "):
                parts.append(waiting + part)
                waiting = ""
            else:
                waiting += SPACE
        return parts + [waiting[1:]] if waiting else parts

    def count(self, texts: list[str]) -> list[int]:
        """Pieces of each text. Parts (a space mark and what follows) are counted once and remembered."""
        if len(self.counts) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.counts, self.held = {}, 0
        split = [self._parts(t) if t else [] for t in texts]
        counts = self.counts
        for part in {p for parts in split for p in parts} - counts.keys():
            counts[part] = self.viterbi(SPACE + part)
            self.held += len(part)
        return [sum([counts[p] for p in parts]) for parts in split]


_COUNTERS: dict[int, Counter] = {}


def _counter(broadcast) -> Counter:
    key = hash(frozenset(broadcast.value.items()))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(broadcast.value)
    return _COUNTERS[key]


def _run(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter | None = None
        for batch in batches:
            counter = counter or _counter(broadcast)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            group: list[str] = []
            size = 0
            for text in texts:
                if group and size + len(text) > GROUP_CHARS:
                    counts += counter.count(group)
                    group, size = [], 0
                group.append(text)
                size += len(text)
            counts += counter.count(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` per row of ``docs``: pieces of the best segmentation under the scores at ``path``.

    A space is its mark and one more mark stands before the text; nothing else is normalized. Null and
    empty texts have no tokens; repeated rows give repeated rows; other columns are ignored. The broadcast
    is the vocabulary, whose size doesn't depend on the documents.
    """
    scores = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _run(scores), f"doc_id {kind}, n_tokens bigint")

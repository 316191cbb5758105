"""How much work the text operators make of large groups, and what they hold while they run."""

from __future__ import annotations

import gc
import random
import string
import tempfile
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken

from driftline.llm import bpe, near_dedup, suffix_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_a_large_group_of_near_copies_is_not_paired_out(docs_of, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = [f"w{k}" for k in range(150)]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(words)
    proposed, verify = [], near_dedup._Links.verify

    def counted(self, pairs):
        pairs = near_dedup.materialize(pairs, "seen")
        proposed.append(pairs.count())
        verify(self, pairs)

    monkeypatch.setattr(near_dedup._Links, "verify", counted)
    got = near_dedup.near_duplicates(docs_of([(i, " ".join(t)) for i, t in enumerate(texts)]), width=3, percent=85).collect()
    sets = [{tuple(t[k:k + 3]) for k in range(len(t) - 2)} for t in texts]
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        before = list(least)
        for i, a in enumerate(sets):
            for j in range(i):
                if least[i] != least[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(least))
    assert sum(proposed) <= 10 * len(texts), proposed


@pytest.mark.parametrize("held", [0, suffix_dedup.HELD])
def test_small_columns_stay_in_memory(monkeypatch, held):
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))).encode() for _ in range(50)]
    edges = np.cumsum([0] + [len(s) for s in strings])
    files, make = [], tempfile.TemporaryFile
    monkeypatch.setattr(tempfile, "TemporaryFile", lambda: files.append(make()) or files[-1])
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    got = suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), edges, 5)
    places = [s[k:k + 5] for s in strings for k in range(len(s))]
    whole = [p for p in places if len(p) == 5]
    assert got.tolist() == [len(p) == 5 and whole.count(p) > 1 for p in places]
    assert len(files) == (0 if held else 4) and all(f.closed for f in files)


@pytest.mark.parametrize("shared", [0, 8, 9, 10, 25])
def test_strings_that_share_no_window_are_not_placed(monkeypatch, shared):
    rng = random.Random(shared)
    strings = [bytes(rng.choice(b"abcdefgh") for _ in range(30)) for _ in range(40)] + [b"", b"ab"]
    middle = bytes(rng.choice(b"xyz") for _ in range(shared))
    strings[5:7] = [strings[5][:3] + middle + strings[5][:9], strings[6][:12] + middle + strings[6][12:]]
    placed, order = [], suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda body, edges: placed.append(len(edges) - 1) or order(body, edges))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    got = suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), edges, 10)
    windows = [s[i:i + 10] for s in strings for i in range(len(s))]
    whole = [w for w in windows if len(w) == 10]
    assert got.tolist() == [len(w) == 10 and whole.count(w) > 1 for w in windows]
    assert placed == [2 if shared >= 9 else 0] and got.any() == (shared >= 10)


def test_an_encoder_counts_what_it_remembers(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1000)) for _ in range(20)]
    encoder = bpe.Encoder(bpe.Vocabulary.read(RANKS, public_tokenizers.PATTERN))
    encoder.encode([" ".join(texts[0].split(" ")[:10])])
    gc.collect()
    tracemalloc.start()
    first = encoder.encode(texts)
    gc.collect()
    remembered = tracemalloc.get_traced_memory()[0] - sum(len(i) + len(d) for i, d in first)
    tracemalloc.stop()
    assert 0.5 * remembered <= encoder.held <= 4 * remembered
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", encoder.held // 4)
    again = [c for text in texts for c in encoder.encode([text])]
    assert again == first and encoder.held < 2 * bpe.REMEMBERED_BYTES


def _contracted(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One pair at a time: of the least rank, the leftmost."""
    tokens = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not found:
            return [ranks[t] for t in tokens]
        i = min(found)[1]
        tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]


def test_pairs_contracted_in_one_round_are_those_contracted_one_by_one():
    rng = random.Random(11)
    for trial in range(12):
        letters = "abcd"[:rng.randint(2, 4)]
        longer = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))).encode() for _ in range(rng.randint(5, 60))}
        tokens = [bytes([i]) for i in range(256)] + sorted(longer, key=lambda t: (len(t) if trial % 2 else 0, rng.random()))
        vocabulary = bpe.Vocabulary({t: i for i, t in enumerate(tokens)}, public_tokenizers.PATTERN)
        assert not (vocabulary.before[vocabulary.alone].any() or vocabulary.behind[vocabulary.alone].any())
        pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))).encode() for _ in range(300)]
        for piece, (ids, decoded) in zip(pieces, bpe.Encoder(vocabulary).contract(pieces), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == _contracted(piece, vocabulary.ranks) and decoded == piece


def test_words_of_a_text_are_not_cut_one_by_one():
    """Only heads of texts and parts that aren't a word and marks take the pattern; white space beside a space, whole texts."""
    vocabulary = bpe.Vocabulary.read(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    encoder = bpe.Encoder(vocabulary)
    asked, find = [], encoder.find
    encoder.find = lambda text: asked.append(text) or find(text)
    whole = [f"a{white} b" for white in "\t\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000"] + [" a", "a ", "a  b", "a \n"]
    texts = ["Qwzx vbnq it's vbnq", *whole, "", "one", "a\nb c", "漢字 éa vbnq", "x 's 12 \u200b",
              "y vbnq?! été.. [a] a[] $$ c++ d`^ \u0301 e\u0301 f\u00d7 漢, Жук; \u00aa"]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and decoded == text.encode()
    assert set(asked) == {"Qwzx", " it's", *whole, "", "one", "a\nb", "漢字", "x", " 's", " 12", " \u200b",
                          "y", " [a]", " $$", " \u0301", " e\u0301", " f\u00d7", " \u00aa"}


def test_letters_and_marks_are_those_of_the_pattern():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def of(kind):
        return pc.extract_regex(pa.array(list(every)), f"(?P<one>[{kind}])").drop_null().field(0).to_pylist()

    assert set(of(bpe.LETTERS)) <= set(regex.findall(r"\p{L}", every)) and "z" in of(bpe.LETTERS)
    assert set(of(bpe.MARKS)) == set(string.punctuation) - {"'"} <= set(regex.findall(r"[^\s\p{L}\p{N}]", every))


def test_a_worker_keeps_no_encoder_after_its_task(docs_of):
    assert bpe.encode_texts(docs_of([(i, f"word{i} of text") for i in range(40)]), RANKS, public_tokenizers.PATTERN).count() == 40

    def alive(batches):
        for batch in batches:
            n = sum(isinstance(o, bpe.Encoder) for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    ids = docs_of([(i, "") for i in range(40)]).select("doc_id").repartition(8)
    assert {r["n"] for r in ids.mapInArrow(alive, "n long").collect()} == {0}

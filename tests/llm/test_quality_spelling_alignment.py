"""Quality, spelling groups and tokenizer alignment against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import alignment, quality, spelling

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- quality

def described(text):
    body = np.frombuffer(text.encode(), np.uint8)
    return dict(zip(quality.FEATURES, quality._described(body, np.array([0, len(body)]))[0]))


def test_features_of_a_text():
    found = described("Ab cd! cd cd\nx7 Ab cd!\nx7 Ab cd!")
    assert found["words"] == pytest.approx(np.log1p(10))
    assert found["capital_starts"] == pytest.approx(0.3) and found["sign_ends"] == pytest.approx(0.3)
    assert found["distinct"] == pytest.approx(0.4) and found["commonest"] == pytest.approx(0.3)
    assert found["lines_repeated"] == pytest.approx(1 / 3) and found["near_repeats"] == pytest.approx(0.1)
    assert found["pairs_repeated"] == pytest.approx(1 - 6 / 9) and found["triples_repeated"] == pytest.approx(1 - 7 / 8)
    assert set(described("").values()) == {0.0}


def test_texts_of_a_chunk_are_described_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab A!\n1é") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    bodies = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(b) for b in bodies])
    together = quality._described(np.frombuffer(b"".join(bodies), np.uint8), at)
    alone = np.array([list(described(t).values()) for t in texts])
    assert np.allclose(together, alone)


def invented(rng, good):
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 90))]
    return (" ".join(words).capitalize() + ".") if good else "!! ".join(w.upper() for w in words)


def test_quality_of_held_out_texts(spark):
    rng = random.Random(3)
    truth = {i: rng.random() < 0.6 for i in range(1500)}
    docs = spark.createDataFrame([(i, invented(rng, g), "x") for i, g in truth.items()], "doc_id long, text string, good string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in truth.items() if i % 2] + [(None, 1), (4, None)],
                                   "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(found) == 1500
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    wrong = [i for i, r in found.items() if r.held_out and r.predicted != truth[i]]
    assert len(wrong) <= 0.03 * sum(r.held_out for r in found.values())


def test_prior_is_the_share_of_good_texts(spark):
    rng = random.Random(5)
    truth = [rng.random() < 0.3 for _ in range(2000)]
    docs = spark.createDataFrame([(i, invented(rng, g)) for i, g in enumerate(truth)], "doc_id long, text string")
    table = docs.mapInArrow(quality._describe, "doc_id long, features binary").join(
        spark.createDataFrame([(i, g and i % 2 == 0) for i, g in enumerate(truth)], "doc_id long, good boolean"), "doc_id")
    assert quality.Fit(table).prior() == pytest.approx(sum(truth) / 2000, abs=0.06)


def test_labels_of_held_out_and_bad_texts_change_nothing(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, invented(rng, i % 3 > 0)) for i in range(200)], "doc_id long, text string")
    known = [(i, 1) for i in range(200) if i % 3 and zlib.crc32(str(i).encode()) % 5]
    other = [(i, 1) for i in range(200) if not zlib.crc32(str(i).encode()) % 5] + [(0, 0)]
    score = lambda labels: rows(quality.score_quality(
        docs, spark.createDataFrame(labels, "doc_id long, quality int")).select("doc_id", F.round("score", 6)))
    assert score(known) == score(known + [x for x in other if x not in known])


def test_quality_of_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = [(1, None), (1, ""), (None, "A b"), (2, "x " * 300_000), (2, "x " * 300_000), (3, "\x00\n\n")]
    assert {r.score for r in quality.score_quality(docs_of(odd), none).collect()} == {0.0}
    scored = quality.score_quality(docs_of(odd), spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, quality int")).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(docs_of([]), none).count() == 0


# --- spelling groups

def spelled(docs, least_letters=5, least_count=3):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    near = defaultdict(set)
    for x in words:
        for y in words:
            if x < y and one_edit(x, y):
                near[x].add(y)
                near[y].add(x)
    form = {}
    for w in near:
        best = min(near[w], key=lambda x: (-words[x], x))
        if words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(x) + 1 == len(y) and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


@pytest.mark.parametrize("seed", range(3))
def test_spelling_groups(docs_of, seed):
    rng = random.Random(seed)
    letters = ["ab", "abé", "aÀÿb÷"][seed]
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(160)]
    pool += ["a" * k for k in range(5, 9)] + ["Abab" * 12 + x for x in ("", "a", "b", "bb")]
    docs = [(i % 40 or None, rng.choice([" ", "1", "\n"]).join(rng.choices(pool, k=rng.randint(0, 90)))) for i in range(60)]
    docs += [(7, None), (7, ""), (8, docs[3][1]), (8, docs[3][1])]
    assert rows(spelling.spelling_groups(docs_of(docs))) == spelled(docs)


def test_dropped_letters(docs_of):
    docs = [(i, "Variante Entwurf") for i in range(400)]
    found = rows(spelling.spelling_groups(docs_of(docs)))
    assert found == spelled(docs) and len(found) > 0 and {r[2] for r in found} == {"variante", "entwurf"}


def test_every_place_of_an_edit(spark):
    word = "abcdefghij"
    others = {word[:i] + "x" + word[i + k:] for i in range(11) for k in (0, 1)} | {word[:i] + word[i + 1:] for i in range(10)}
    table = spark.createDataFrame([(w, 1) for w in sorted({word} | others)], "word string, n long")
    found = {(r.word, r.other) for r in spelling.one_edit_pairs(table).collect()}
    names = sorted({word} | others)
    assert found == {(x, y) for x in names for y in names if x < y and one_edit(x, y)}
    assert spelling.one_edit_pairs(table).count() == len(found)


def test_long_words_cost_what_they_share(docs_of):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    other = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    docs = [(i, f"{long} {other} {long[:9]} {long[:10]}") for i in range(3)]
    assert rows(spelling.spelling_groups(docs_of(docs))) == spelled(docs)


def test_spelling_of_nothing(docs_of):
    assert spelling.spelling_groups(docs_of([])).count() == 0
    assert spelling.spelling_groups(docs_of([(1, None), (2, "a bc 12 short")])).count() == 0


# --- alignment

def aligned(docs):
    left = Tokenizer.from_file(BYTES)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_a, bytes_b = (kind(Path(p).read_bytes(), public_tokenizers.PATTERN).entries.to_pylist() for kind, p in (
        (alignment.ByteLevel, BYTES), (alignment.Pieces, PIECES)))
    found, counts = [], Counter()
    for doc, text in docs:
        a = left.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        body = f" {text or ''}".encode()
        if not text or b"".join(bytes_a[i] for i in a) != body or b"".join(bytes_b[i] for i in b) != body:
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(table[i])))
                at += len(table[i])
            spans.append(side)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        groups, start = [], 0
        for end in sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if s >= start and e <= end) for side in spans))
            start = end
        found.append((doc, a, b, groups, links))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                   for doc, a, b, groups, links in found), key=repr)


def align(docs, **settings):
    return rows(alignment.align_tokenizers(docs, Path(BYTES).read_bytes(), Path(PIECES).read_bytes(),
                                           public_tokenizers.PATTERN, **settings))


def odd_texts():
    rng = random.Random(4)
    words = ["the", "them", "Ünder", "don't", "  ", "\n", "x" * 40, "１２", "日本語", "🙂🙂", "<|endoftext|>", "a▁b", "</s>",
             "<0x41>", " ", "1234567", "\t", "ﬁ", "é", "\x00", "'S", "​", "aaa"]
    return ["", None, " ", "  ", "a", " a", "a ", "\n"] + ["".join(
        rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(120)]


def test_alignment(docs_of):
    docs = [(i % 90 or None, t) for i, t in enumerate(odd_texts() * 2)]
    assert align(docs_of(docs)) == aligned(docs)


@pytest.mark.parametrize("part, chunk", [(20, 1), (50, 300)])
def test_alignment_by_parts_and_chunks(docs_of, monkeypatch, part, chunk):
    monkeypatch.setattr(alignment, "parts_of", lambda t, limit=part, whole=alignment.parts_of: whole(t, limit))
    docs = [(i, t) for i, t in enumerate(odd_texts())]
    coders = [kind(Path(p).read_bytes(), public_tokenizers.PATTERN) for kind, p in (
        (alignment.ByteLevel, BYTES), (alignment.Pieces, PIECES))]
    cut, whole = alignment._Chunk(), alignment._Chunk()
    cut.add([i for i, _ in docs], [t or "" for _, t in docs], *coders)
    monkeypatch.undo()
    whole.add([i for i, _ in docs], [t or "" for _, t in docs], *coders)
    for x, y in zip(cut.a + cut.b, whole.a + whole.b):
        assert x.tolist() == y.tolist()
    assert align(docs_of(docs), chunk_bytes=chunk) == aligned(docs)


def test_byte_level_ids_are_those_of_the_library():
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    coder = alignment.ByteLevel(Path(BYTES).read_bytes(), public_tokenizers.PATTERN)
    assert coder._own is None
    rng = random.Random(9)
    texts = [t for t in odd_texts() if t] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(
        0x3040, 0x30FF), rng.randint(0x1F300, 0x1F640), 32])) for _ in range(200)) for _ in range(200)] + ["é" * 5000, "ab" * 5000]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == own.encode(f" {text}", add_special_tokens=False).ids


def test_a_file_whose_ids_are_not_ranks_goes_through_its_library():
    import json
    model = json.loads(Path(BYTES).read_bytes())
    model["model"]["merges"][100:200] = model["model"]["merges"][100:200][::-1]
    source = json.dumps(model).encode()
    own = Tokenizer.from_str(source.decode())
    coder = alignment.ByteLevel(source, public_tokenizers.PATTERN)
    assert coder._own is not None
    assert coder.encode(["the reindeer"])[0].tolist() == own.encode(" the reindeer", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_groups_end_where_both_sides_end(seed):
    rng = random.Random(seed)
    size = rng.randint(1, 300)
    ends = [np.array(sorted(set(rng.choices(range(1, size + 1), k=rng.randint(1, size))) | {size})) for _ in range(2)]
    a, b = alignment.groups_of(*ends)
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    for got, side in zip((a, b), ends):
        assert got.tolist() == np.searchsorted(common, side).tolist()


def test_alignment_of_nothing_and_of_a_long_text(docs_of):
    assert align(docs_of([])) == []
    docs = [(1, "word and words, " * 40_000), (2, "ab" * 100_000)]
    got = align(docs_of(docs))
    assert [r[0] for r in got] == [1, 2] and all(r[3] > 0 for r in got)
    left = Tokenizer.from_file(BYTES)
    assert [r[1] for r in got] == [len(left.encode(f" {t}", add_special_tokens=False).ids) for _, t in docs]

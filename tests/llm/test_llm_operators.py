"""The text operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from driftline.llm import bpe, chat, decontaminate, exact_dedup, html_text, licenses, near_dedup, suffix_dedup, token_counts, toxicity
from driftline.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(rng, count, pool=("a", "bb", "Cc", "é", "dog", "ox")):
    return " ".join(rng.choice(pool) for _ in range(count))


# --- repeated strings

@pytest.mark.parametrize("seed", range(40))
def test_windows_of_a_collection(seed):
    rng = random.Random(seed)
    size = rng.choice([2, 3, 5])
    strings = ["".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(size, 14))).encode()
               for _ in range(rng.randint(1, 9))]
    edges = np.cumsum([0] + [len(s) for s in strings])
    got = suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), edges, size)
    seen = Counter(s[k:k + size] for s in strings for k in range(len(s) - size + 1))
    assert got.tolist() == [k + size <= len(s) and seen[s[k:k + size]] > 1 for s in strings for k in range(len(s))]


def test_rows_by_symbol_are_placed_by_runs():
    rng = np.random.default_rng(5)
    for _ in range(50):
        bwt = np.repeat(rng.integers(0, 4, 12), rng.integers(1, 6, 12)).astype(np.uint8)
        rows = np.flatnonzero(rng.random(len(bwt)) < 0.4)
        at, before, after = suffix_dedup._same_symbol(bwt, rows)
        order = sorted(range(len(bwt)), key=lambda i: (bwt[i], i))
        for k, row in enumerate(rows.tolist()):
            alike = [i for i in range(len(bwt)) if bwt[i] == bwt[row]]
            assert order[at[k]] == row
            assert before[k] == max((i for i in alike if i < row), default=-1)
            assert after[k] == min((i for i in alike if i > row), default=-1)


def without_repeats(texts, size):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + size] for b in bodies for k in range(len(b) - size + 1))
    out = []
    for b in bodies:
        cover = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                cover[k:k + size] = b"\1" * size
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("collection", [2048, 2])
def test_remove_repeats(docs_of, monkeypatch, collection):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    rng = random.Random(3)
    passage = words(rng, 90)
    texts = [None, "", "short", "x" * 900, passage, "é" + passage + words(rng, 40), words(rng, 30) + passage[20:],
             words(rng, 400), "ab" * 300 + "c", passage, passage]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[7])])
    expected = without_repeats([*texts, texts[5], texts[7]], 200)
    got = rows(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    ids = [*range(len(texts)), None, 7]
    assert got == sorted(((i, *e) for i, e in zip(ids, expected, strict=True)), key=repr)
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


# --- exact duplicates

def test_exact_groups(docs_of):
    texts = [(5, "a  b"), (2, "a\tb"), (9, None), (4, ""), (7, " "), (8, "a b "), (3, "é"), (3, "é"), (None, "zz"),
             (11, "long " * 20_000), (10, "long\n" * 20_000)]
    for counters in (1, 1024):
        got = rows(exact_dedup.duplicate_groups(docs_of(texts), counters=counters), "doc_id", "keep_id", "group_size", "kept")
        assert got == sorted([(5, 2, 2, False), (2, 2, 2, True), (9, 4, 2, False), (4, 4, 2, True), (7, 7, 1, True),
                              (8, 8, 1, True), (3, 3, 2, True), (3, 3, 2, True), (None, None, 1, True),
                              (11, 10, 2, False), (10, 10, 2, True)], key=repr)
    assert exact_dedup.duplicate_groups(docs_of([])).count() == 0
    assert exact_dedup.drop_duplicates(docs_of(texts[:2])).columns == docs_of([]).columns


def test_frequent_digests_are_found(docs_of):
    docs = docs_of([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(300)]).repartition(7)
    marked = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    found, count = exact_dedup.frequent_digests(marked, 4)
    assert count == 300 and hashlib.sha256(b"hot").digest() in found and len(found) <= 4


# --- chat

def test_perspectives(spark):
    turns = spark.createDataFrame(
        [(1, 0, "ann", "Hi", 0), (1, 1, "bob", None, 0), (1, 2, "ann", "é!", 0), (2, None, None, "solo", 0), (None, 0, "x", "", 0)],
        "conv_id long, turn long, role string, text string, piece int")
    got = {(r["conv_id"], r["speaker"], r["piece"]): (r["text"], r["mask"], r["n_turns"])
           for r in chat.render_perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", None), (None, "x", 0)}
    text, mask, count = got[(1, "ann", 0)]
    assert text == ("<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
                    "<|im_start|>assistant\né!<|im_end|>\n") and count == 3
    assert [text[a:b] for a, b in eval(mask)] == ["Hi<|im_end|>", "é!<|im_end|>"]
    assert chat.render_perspectives(turns.limit(0)).count() == 0


def test_long_and_tied_dialogues_are_cut(spark):
    turns = spark.range(300).select(F.lit(1).alias("conv_id"), F.when(F.col("id") < 150, 3).otherwise(F.col("id")).alias("turn"),
                                    F.lit("a").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.render_perspectives(turns).orderBy("piece", "part").collect()
    assert sum(r["n_turns"] for r in got) == 300 and max(r["n_turns"] for r in got) == 64
    bodies = re.findall(r"assistant\n(\d+)<", "".join(r["text"] for r in got))
    assert sorted(map(int, bodies)) == list(range(300)) and bodies[150:] == [str(i) for i in range(150, 300)]


# --- toxicity

def test_toxicity_separates_held_out_texts(spark):
    rng = random.Random(1)
    pool = [f"{a}{b}{c}" for a in ("th", "er", "on") for b in ("a", "o") for c in ("n", "st", "ly")]
    bad = ["zorgul", "zorgulen", "zorgulix"]
    texts, labels = [], []
    for i in range(240):
        said = [rng.choice(pool) for _ in range(40)]
        if i % 4 == 0:
            for k in (3, 17, 30):
                said[k] = rng.choice(bad)
        texts.append((i, " ".join(said)))
        labels.append((i, 0, int(i % 4 == 0)))
    texts += [(None, "x"), (900, None), (901, ""), (5, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit(0))
    marks = spark.createDataFrame([*labels, (7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks, bits=16).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert len(held) > 40
    assert sum((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, marks.limit(0)).collect()} == {0.0}


def brute_ratios(counts):
    """log P(toxic) - log P(ordinary) of each 6-gram (bytes) by exact Kneser-Ney counts; counts: gram -> [ordinary, toxic]."""
    levels = {6: counts}
    for order in range(5, 0, -1):
        held = {}
        for gram, n in levels[order + 1].items():
            into = held.setdefault(gram[1:], [0, 0])
            for c in (0, 1):
                into[c] += int(any(n) if order <= 3 else n[c] > 0)
        levels[order] = held
    sums = {}
    for order, held in levels.items():
        for gram, n in held.items():
            for c in (0, 1):
                d = sums.setdefault((gram[:-1], order, c), [0, 0])
                d[0], d[1] = d[0] + n[c], d[1] + (n[c] > 0)

    def p(gram, c):
        if not gram:
            return 1 / 256
        total, kinds = sums.get((gram[:-1], len(gram), c), (0, 0))
        shorter = p(gram[1:], c)
        return (max(levels[len(gram)].get(gram, (0, 0))[c] - 0.75, 0) + 0.75 * kinds * shorter) / total if total else shorter

    return {g: np.log(max(p(g, 1), 1e-12)) - np.log(max(p(g, 0), 1e-12)) for g in counts}


def byte_grams(text):
    body = b"\n" * 5 + lower(text).encode()
    return [body[k:k + 6] for k in range(len(body) - 5)]


def test_toxicity_ratios_are_of_whole_grams(spark):
    """Far more grams than 2^8, the bits that are asked for: none shares its counts with another."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé Z") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    kinds = [k % 5 for k in range(60)]
    counted = toxicity.count_grams(spark.createDataFrame(list(zip(texts, kinds)), "text string, kind int"))
    got = {r["gram"].to_bytes(6, "big"): r for r in toxicity.gram_ratios(counted).collect()}
    for name, used in (("ratio", (0, 1, 2, 3)), ("fitted", (0, 1))):
        counts = {g: [0, 0] for t in texts for g in byte_grams(t)}
        for text, kind in zip(texts, kinds):
            for gram in byte_grams(text) if kind in used else ():
                counts[gram][kind % 2] += 1
        expected = brute_ratios(counts)
        assert expected.keys() == got.keys() and len(got) > 1000
        assert all(abs(got[g][name] - r) < 1e-4 for g, r in expected.items())


def test_toxicity_unseen_grams_back_off(spark):
    """Grams of which training has only a shorter end, or nothing, by the model that travels."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeé Z") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    others = ["".join(rng.choice("abcdefghé Zxü") for _ in range(50)) for _ in range(20)] + ["", "a"]
    kinds = [k % 4 for k in range(40)]
    counted = toxicity.count_grams(spark.createDataFrame(list(zip(texts, kinds)), "text string, kind int"))
    asked = sorted({g for t in [*texts, *others] for g in byte_grams(t)})
    for name, used in (("ratio", (0, 1, 2, 3)), ("fitted", (0, 1))):
        model = pickle.loads(pickle.dumps(toxicity.Model(counted.select("gram", *toxicity.CLASSES[name]).toArrow())))
        counts = {g: [0, 0] for g in asked}
        for text, kind in zip(texts, kinds):
            for gram in byte_grams(text) if kind in used else ():
                counts[gram][kind % 2] += 1
        assert sum(not any(n) for n in counts.values()) > 300
        expected = brute_ratios(counts)
        got = model.ratios(np.array([int.from_bytes(g, "big") for g in asked], np.uint64))
        assert np.abs(got - np.array([expected[g] for g in asked])).max() < 1e-4


def toxic_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))) + (" zorgul" if i % 4 == 0 else "")
             for i in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (900, None), (901, ""), (5, "again")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")


def test_toxicity_joined_by_chunk_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_JOINED", 300)
    docs, marks = toxic_texts(spark)
    both = [rows(toxicity.score_toxicity(docs, marks, bits=bits), "doc_id", "held_out", "predicted", F.round("score", 9),
                 F.round("mean", 9), F.round("peak", 9)) for bits in (2, 22)]
    assert both[0] == both[1] and len(both[0]) == 124


def test_toxicity_counts_all_labelled_texts(spark, monkeypatch):
    """Fitting holds back the bounded rows only; scores come from the counts of every labelled training text."""
    seen, real = [], toxicity.Ratios
    monkeypatch.setattr(toxicity, "Ratios", lambda counted, bits: seen.append(counted) or real(counted, bits))
    docs, marks = toxic_texts(spark)
    toxicity.score_toxicity(docs, marks, fit_rows=3)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 120 AND text <> 'again'").collect()}
    training = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1]
    extra = "again" if 5 in training else ""
    total = seen[0].agg(F.sum(F.expr("n0 + n1")), F.sum(F.expr("m0 + m1"))).first()
    assert total[0] == sum(len(texts[i]) for i in training) + len(extra)
    held_back = total[0] - total[1]
    assert 0 < held_back <= sum(sorted(len(t) for t in texts.values())[-3:]) + len(extra)


# --- decontamination

def hits(text, items):
    said, mask, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), [], set()
    mask = [False] * len(said)
    for item, phrase in items:
        part = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(phrase))
        for k in range(max(1, len(part) - 9) if part else 0):
            window = part[k:k + 10]
            for p in range(len(said) - len(window) + 1):
                if said[p:p + len(window)] == window:
                    found.add(str(item) if item is not None else "null")
                    mask[p:p + len(window)] = [True] * len(window)
    return len(said), sum(mask), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(mask)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 24), (2, 40), (3, 200)])
def test_contamination(spark, docs_of, monkeypatch, seed, block):
    rng = random.Random(seed)
    items = [(k % 9, words(rng, rng.choice([0, 1, 3, 10, 11, 30]))) for k in range(10)] + [(None, "dog dog"), (3, None)]
    texts = [None, "", "!!", *[words(rng, rng.randint(1, 80)) for _ in range(12)], items[4][1] + " zz " + items[5][1]]
    docs, bench = docs_of(enumerate(texts)), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    found = decontaminate.find_benchmark(docs, bench, block_chars=block)
    for r in found.collect():
        expected = hits(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(set(r["items"]))) == expected[:3]
    got = rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *hits(t, items)) for i, t in enumerate(texts)), key=repr)
    assert decontaminate.contamination(docs_of([]), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


# --- near duplicates

def linked_groups(texts, width, percent):
    sets = {}
    for i, t in texts:
        said = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(said[k:k + width]) for k in range(max(1, len(said) - width + 1))} if said else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i), root(i) == i) for i in sets]


@pytest.mark.parametrize("short", [24, 3])
def test_near_duplicates(docs_of, monkeypatch, short):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short)
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(400)]
    texts = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "three"), (5, " \n")]
    for base in range(4):
        said = [rng.choice(pool) for _ in range((30, 90, 200, 45)[base])]
        for copy in range(8):
            edited = list(said)
            for _ in range(copy % 5):
                edited[rng.randrange(len(edited))] = "edit"
            texts.append((100 + base * 20 + copy, " ".join(edited)))
    texts += [(200 + k, " ".join(rng.choice(pool) for _ in range(60))) for k in range(6)]
    rng.shuffle(texts)
    got = rows(near_dedup.near_duplicates(docs_of(texts), width=3, percent=85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(linked_groups(texts, 3, 85), key=repr)


def test_near_duplicates_of_nothing(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).count() == 0
    got = rows(near_dedup.near_duplicates(docs_of([(None, "a b c"), (3, "a b c"), (None, None)])), "doc_id", "component_id", "kept")
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, True)], key=repr)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 80), (5, 5)], "a long, b long")
    got = dict(rows(connected_components(links), "node", "label"))
    assert got == {**dict.fromkeys(range(1, 41), 1), 80: 80, 90: 80, 100: 80}


# --- pages

def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(80):
        size = rng.randint(1, 8)
        odds = [rng.choice([-3, -1, 0, 1, 2, 0.5, -0.25]) for _ in range(size)]
        edges = [(a, b, rng.choice([0.5, 1, 2])) for a, b in ((rng.randrange(size), rng.randrange(size)) for _ in range(9)) if a != b]

        def cost(kept, odds=odds, edges=edges):
            return (sum(max(0, -o) if k else max(0, o) for o, k in zip(odds, kept, strict=True))
                    + sum(w for a, b, w in edges if kept[a] != kept[b]))

        best = min(cost(k) for k in itertools.product([False, True], repeat=size))
        assert abs(cost(html_text.minimum_cut(odds, edges)) - best) < 1e-6


def test_pages(spark):
    page = ('<html><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies, '
            'as all the others do, and that is that.</p></div><div><h2>Title</h2><p>A long paragraph of real text, with many words '
            'in it &amp; more.<p>Second   one\n &lt;b&gt; caf&eacute;.</p><form>Name <input></form></div><section class="comments">'
            '<p>A reader writes a long comment here that has nothing to do with the text.</p></section><footer>&copy; me</footer>')
    pages = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "v", "", 0), (4, "w", "<script>x", 0), (4, "w", "<", 0)],
                                  "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()}
    text = "Title\nA long paragraph of real text, with many words in it & more.\nSecond one <b> café."
    assert got[(1, "u")] == (text, len(text)) and got[(2, None)] == ("", 0) and got[(4, "w")] == ("", 0)
    assert html_text.extract_pages(pages).count() == 5 and html_text.extract_pages(pages.limit(0)).count() == 0


# --- token counts

def test_best_segmentation():
    rng = random.Random(2)
    scores = {"▁": -5.0, "a": -2.0, "b": -2.0, "ab": -3.0, "ba": -3.0, "▁a": -3.0, "aba": -5.0, "▁ab": -4.0, "bb": -4.0}
    counter = token_counts.Counter(scores)

    def best(text):
        table = {0: (0.0, 0)}
        for start in range(len(text)):
            for end in range(start + 1, len(text) + 1):
                piece = text[start:end]
                score = scores.get(piece, counter.unknown if end == start + 1 else None)
                if score is not None and (end not in table or table[start][0] + score > table[end][0]):
                    table[end] = (table[start][0] + score, table[start][1] + (1 if piece in scores else len(piece.encode())))
        return table[len(text)][1]

    texts = ["", "c", "aé b", "a  b", " a", "b ", "▁a b"] + ["".join(rng.choice("aab b") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    assert counter.count(texts) == [best("▁" + t.replace(" ", "▁")) if t else 0 for t in texts]


def test_token_counts(docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = dict(rows(token_counts.count_tokens(docs_of([(1, None), (2, ""), (3, "hello world"), (4, "the " * 30_000)]), path), "doc_id", "n_tokens"))
    assert got[1] == got[2] == 0 and got[3] > 1 and got[4] >= 30_000
    assert token_counts.count_tokens(docs_of([]), path).count() == 0


# --- licenses

def test_licenses(docs_of):
    texts = ["Licensed under CC BY-NC 4.0.", "x\nGNU General Public License; ALL RIGHTS, reserved. cc by cc by", None, "", "cc by1 by",
             "Kcc by", "a " * 70 + "This work is licensed under the GNU General Public License, version 3.", "clean text", "cc " * 5000 + "by"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        said = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            part = phrase.split(" ")
            at = [k for k in range(len(said)) if said[k:k + len(part)] == part]
            places += at
            base |= {label} if at else set()
        blocks = [set(said[b:b + licenses.BLOCK]) for b in range(0, max(1, len(said)), licenses.STEP)]
        more = {}
        for label, template in licenses.TEMPLATES.items():
            tokens = set(template.split(" "))
            share = max(len(tokens & b) for b in blocks) / len(tokens)
            if share >= licenses.CONTAINMENT:
                more[label] = share
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(said), len(places)), text
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | set(more)))
        assert r["score"] == pytest.approx(1.0 if base else max(more.values(), default=0.0))
    assert licenses.scan_licenses(docs_of([])).count() == 0


# --- byte pairs

def test_bpe_equals_the_library(docs_of):
    rng = random.Random(5)
    vocabulary = bpe.Vocabulary.read(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = [None, "", "a" * 3001, " " * 900, "-" * 999, "ab" * 700, "\x00é漢字🎉" * 20, "I'm don't  12345 \n\n x", " a", "a ", "<|endoftext|>"]
    texts += ["".join(rng.choice("aeétn 1-🎉漢\n") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    got = bpe.encode_texts(docs_of(enumerate(texts)), RANKS, public_tokenizers.PATTERN)
    for r in got.collect():
        expected = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == expected and r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    back = bpe.decode_ids(got, RANKS)
    assert all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") for r in back.collect())
    assert bpe.encode_texts(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_single_tokens_are_decoded_from_their_ids():
    """A wrong id must show in the decoded bytes."""
    vocabulary = bpe.Vocabulary.read(RANKS, public_tokenizers.PATTERN)
    encoder = bpe.Encoder(vocabulary)
    encoder.learn({"dog"})
    wrong = vocabulary.ranks[b"dog"]
    encoder.ranks = {**vocabulary.ranks, b"the": wrong}
    encoder.learn({"the"})
    assert encoder.known["the"] == (wrong.to_bytes(4, "little"), b"dog") == encoder.known["dog"]

"""Every stage of the corpus pipeline against brute force, on what the stage before kept."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from driftline.llm.toxicity import score_toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark, and the ids planted in it."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    fresh = lambda count: [rng.choice(pool) for _ in range(count)]
    texts, toxic, clean = {}, set(), set()
    for i in range(60):
        texts[i] = " ".join(fresh(40))
        clean.add(i)
    for i in range(60, 90):
        some = fresh(30)
        some[8:8] = "zzyx you vvile wworm".split()
        some[20:20] = "qqit zzyx wworm".split()
        texts[i] = " ".join(some)
        toxic.add(i)
    texts[100], texts[101] = texts[3].replace(" ", " \t\n"), texts[3]
    near = texts[7].split()
    near[-1] = "changed"
    texts[102], texts[103] = " ".join(near), " ".join(["Other", *near])  # a chain from 7
    passage = fresh(14)
    texts[104] = " ".join([*fresh(12), *passage, *fresh(12)]).replace(passage[3], passage[3].upper())
    texts[105], texts[106] = ", ".join(passage), " ".join([*passage[:10], *fresh(20), *passage[4:]])
    texts[107], texts[108], texts[109], texts[110] = None, "", "... !", " ".join([*fresh(20), *passage[:9], *fresh(9)])
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in sorted(clean | toxic)],
                          "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    items = [("p", " ".join(passage)), ("none", None), ("short", "zebra crossing")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, clean, items


def exact(docs):
    first = {}
    for i, text in sorted(docs.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    return {i: docs[i] for i in first.values()}


def near(docs):
    sets = {}
    for i, text in docs.items():
        found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))} if found else set()
    least = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if least[a] < least[b] and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    least[b], changed = least[a], True
    return {i: t for i, t in docs.items() if least[i] == i}


def cut(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, text in items:
        found = word.findall(lower(text))
        windows |= {tuple(found[k:k + 10]) for k in range(max(1, len(found) - 9))} if found else set()
    out = {}
    for i, text in docs.items():
        found = [(m[0], m.start(), m.end()) for m in word.finditer(lower(text))]
        hit = [False] * len(found)
        for size in {len(w) for w in windows}:
            for k in range(len(found) - size + 1):
                if tuple(w for w, _, _ in found[k:k + size]) in windows:
                    hit[k:k + size] = [True] * size
        if not any(hit):
            out[i] = text
            continue
        parts, at = [], 0
        for k, (_, start, end) in enumerate(found):
            if hit[k]:
                if not (k and hit[k - 1]):
                    parts.append(text[at:start])
                at = end
        left = "\n".join(p for p in (part.strip(" ") for part in [*parts, text[at:]]) if p)
        if left:
            out[i] = left
    return out


def test_stages(spark, planted, tmp_path):
    folder, texts, toxic, clean, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = {r["doc_id"] for r in score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where(
        "predicted = 1").collect()}
    assert toxic <= scored and not scored & clean
    expected = {i: t for i, t in texts.items() if i not in scored}
    brute = {"toxicity": lambda d: expected, "exact_dedup": exact, "near_dedup": near, "decontaminate": lambda d: cut(d, items)}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        expected = brute[name](expected)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        found = docs.collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in found) == sorted((i, t or "") for i, t in expected.items()), name
        assert all(r["n_chars"] == len(r["text"] or "") and (r["lang"], r["source"]) == ("en", "web") for r in found)
        sizes.append(len(found))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]  # each stage has something to do
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = {i: library.encode_ordinary(t or "") for i, t in expected.items()}
    found = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert {i: r["ids"] or [] for i, r in found.items()} == tokens
    for i, text in expected.items():
        assert found[i]["n_tokens"] == len(tokens[i])
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()

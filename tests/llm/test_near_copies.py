import random

import numpy as np

import corpus_pipeline

from repairlake.llm import near_copies
from repairlake.llm.common import table

from .conftest import odd_rows
from .test_rules_and_dedup import WORD


def plain_shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def bits_of(text):
    (words, _), = near_copies.word_and_shingle_sets([text], 5)
    return near_copies.set_fingerprint(words) & (1 << 64) - 1


def brute_kept(rows, max_bits=near_copies.MAX_BITS):
    """The least doc_id (nulls last) of each component of pairs of Jaccard similarity 0.8 or more with near fingerprints."""
    sets = sorted({plain_shingles(t) for _, t in rows}, key=sorted)
    text = {plain_shingles(t): t for _, t in rows}
    fps = [bits_of(text[s]) for s in sets]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if 5 * same >= 4 * (len(a) + len(sets[j]) - same) and (a or not sets[j]) and (sets[j] or not a) and (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    at, least = {s: find(i) for i, s in enumerate(sets)}, {}
    for doc_id, t in rows:
        key = (doc_id is None, doc_id or 0)
        least[at[plain_shingles(t)]] = min(key, least.get(at[plain_shingles(t)], key))
    return sorted(None if none else i for none, i in least.values())


def kept(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))


def in_order(ids):
    return sorted(ids, key=lambda i: (i is None, i or 0))


def test_stage_keeps_one_of_similar_documents(spark):
    """Pairs of 0.8 and more go, and pairs below stay."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    clean = spark.createDataFrame(corpus_pipeline.STAGES[0][1](spark, docs, "").collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    got = kept(corpus_pipeline.STAGES[1][1](spark, clean, ""))
    assert got == brute_kept(rows) == brute_kept(rows, 64) and 145 not in got and 177 not in got


def test_dense_groups_of_hot_keys(spark, monkeypatch):
    """Many hot keys, their leaders and what these leave, in several blocks: the same as brute force."""
    monkeypatch.setattr(near_copies, "HOT", 8)
    monkeypatch.setattr(near_copies, "LEAST", 4)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(6)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(50):
            w = list(base)
            for at in rng.sample(range(120), rng.randrange(0, 9)):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_kept(rows)
    assert 20 < len(want) < 180
    assert kept(near_copies.keep_one(df)) == want


def test_parities_never_rule_out_wrongly():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 63, rng.integers(0, 60)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        assert near_copies.differing_parities([near_copies.parities(a)], [near_copies.parities(b)])[0] <= len(np.setxor1d(a, b))


def test_dense_group_and_bound(spark):
    """A group whose members are partly below the bound to each other, chains, and pairs on both sides of it."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    long = [f"l{i}" for i in range(104)]
    texts += [" ".join(long), " ".join(long[:84]), " ".join(long[:83]), "A B c", "a b C", ""]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_kept(rows)
    assert kept(near_copies.keep_one(df)) == want


def test_defined_cases(odd, none):
    got = near_copies.keep_one(odd)
    assert got.columns == odd.columns and kept(got) == in_order(brute_kept([(i, t) for i, t, *_ in odd_rows()]))
    assert near_copies.keep_one(none).count() == 0

import hashlib
import re
from collections import Counter

import pytest

from repairlake.llm import components, quality_rules, simhash, substring_dedup

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(words, k=8):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_rule_counts(odd, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.line_first_quality(odd).collect())
    want = Counter()
    for doc_id, text, *_ in odd_rows():
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = brute_repeats(w)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)] += 1
    assert got == want and quality_rules.line_first_quality(none).count() == 0


def test_line_rules():
    faults = lambda s: quality_rules.line_faults(s.encode(), s.encode().split())
    assert faults("A clean sentence stands here.") == (False, False, False)
    assert faults("no mark at all here")[0] and faults("a%%% b*** c&&& d.")[0] and faults("STOP!! NOW!! PLEASE!!")[0]
    assert faults("Home | About | Contact.")[1] and faults("All rights reserved, 2020.")[2] and faults("go go go go stop.")[2]
    assert faults("Tous droits réservés 2020.")[2] and faults("Click here or use cookies, click here.")[2]
    prose = "a long sentence of prose that happens to say click here once and then goes on for some more words."
    assert not faults(prose)[2] and faults("click here and click here, " + prose)[2]


def test_rules_stage(odd, none):
    text = "A good line of words ends here, with more words in it.\n" * 1 + "Another line has several words of its own too.\nHome | About | Login | Help\nThe last line closes the text with some words."
    spark = odd.sparkSession
    df = spark.createDataFrame([(1, text, "keep", None), (2, "x | y | z | " * 20, "go", 1), (None, None, None, None)], "doc_id bigint, text string, source string, n_chars bigint")
    kept = quality_rules.clean_documents(df).collect()
    assert [r.doc_id for r in kept] == [1] and "Home" not in kept[0].text and kept[0].source == "keep" and kept[0].n_chars == len(kept[0].text)
    assert quality_rules.clean_documents(odd).columns == odd.columns and quality_rules.clean_documents(none).count() == 0
    want = Counter(i for i, t, *_ in odd_rows() if quality_rules.judge(t)[6])
    assert Counter(r.doc_id for r in quality_rules.clean_documents(odd).collect()) == want


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, none):
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd).collect())
    rows = [(i, plain_fingerprint(t)) for i, t, *_ in odd_rows()]
    root = brute_components({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f, least.get(root[f])) for i, f in rows)
    assert simhash.near_duplicates(none).count() == 0


def test_links_for_every_number_of_parts(spark):
    import random

    rng = random.Random(3)
    mask = (1 << 64) - 1
    base = [rng.getrandbits(64) for _ in range(60)]
    dense = [base[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)]
    chain = [base[1]]
    for _ in range(25):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    fps = sorted({*base, *dense, *chain})
    signed = [(f - (1 << 64) if f >> 63 else f, 1) for f in fps]
    want = brute_components(set(fps))
    for parts in (2, 3, 4):
        df = spark.createDataFrame(signed, "fp bigint, n bigint")
        found = {r.node & mask: r.root & mask for r in components.components(simhash.links(df, parts=parts)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(found.get(f, f), set()).add(f)
        brute = {}
        for f in fps:
            brute.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_five_thousand_under_one_key(spark):
    """All agree on 40 bits, so that some key of any part count holds many: chains, a dense group and strangers."""
    import random

    rng = random.Random(8)
    low = [rng.getrandbits(24) for _ in range(4000)]
    dense = [low[0] ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(1, 7))) for _ in range(1000)]
    fps = sorted({*low, *dense})
    near = {b: b for b in fps}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for a in fps:
        for k in range(24):
            for j in range(k, 24):
                for i in range(j, 24):
                    b = a ^ (1 << k | 1 << j | 1 << i)
                    if b > a and b in near:
                        near[find(b)] = find(a)
    df = spark.createDataFrame([(f << 40 | 0x1234567890, 1) if f < 1 << 23 else ((f << 40 | 0x1234567890) - (1 << 64), 1) for f in fps], "fp bigint, n bigint").repartition(4)
    found = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    groups, brute = {}, {}
    for f in fps:
        signed = f << 40 | 0x1234567890
        signed = signed if f < 1 << 23 else signed - (1 << 64)
        groups.setdefault(found.get(signed, signed), set()).add(f)
        brute.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_keep_one_keeps_columns_of_any_name(spark):
    text = "some words that are the same in both of these documents here"
    df = spark.createDataFrame([(1, text, 7, 8, "a"), (2, text, 9, 10, "b"), (None, None, 1, 2, "c")], "doc_id bigint, text string, _own_id int, _own_th int, `keep.id` string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text, 7, 8, "a"), (None, None, 1, 2, "c")], key=str)


@pytest.mark.parametrize("few", [0, 20, 15_000])
def test_components_of_a_path(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionAll(spark.sql("SELECT 200L, 201L")).unionAll(spark.sql("SELECT 5L, 5L"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200} or got == {**{i: 0 for i in range(1, 61)}, 201: 200}


def test_keep_one(odd, none):
    rows = [(i, t, plain_fingerprint(t)) for i, t, *_ in odd_rows()]
    root = brute_components({f for *_, f in rows})
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert sorted(root[plain_fingerprint(r.text)] for r in got) == sorted(set(root.values()))
    for r in got:
        ids = [i for i, _, f in rows if root[f] == root[plain_fingerprint(r.text)] and i is not None]
        assert r.doc_id == (min(ids) if ids else None)
    assert simhash.keep_one(none).count() == 0


def brute_removed(rows, k=50):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = {p for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out.append((i, w, gone))
    return out


@pytest.mark.parametrize("met", [2, 32])
def test_substrings(odd, none, monkeypatch, met):
    """met: the references are in a broadcast shard, or not."""
    monkeypatch.setattr(substring_dedup, "MET", met)
    rows = [(i, t) for i, t, *_ in odd_rows()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_digest(odd).collect())
    want = Counter((i, len(w), len(g), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in g).encode()).hexdigest()) for i, w, g in brute_removed(rows))
    assert got == want and sum(n for _, _, n, _ in got) > 0
    assert substring_dedup.removal_digest(none).count() == 0


def test_texts_that_repeat_themselves(spark):
    """One word, or a line, over and over: bounded rows, and the result of brute force."""
    long = "word " * 200_000
    line = "the same line of nine words again and again " * 900
    rows = [(1, long), (2, long), (3, line), (4, f"something else first {line}"), (5, "x " * 49), (6, "word " * 49), (7, "other " + "word " * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    keyed = substring_dedup._keyed(df)
    assert substring_dedup.anchor_rows(keyed).count() < 2 * 200_000 / 50
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.removal_digest(df).collect()}
    n = len(line.split())
    assert got == {1: (200_000, 0), 2: (200_000, 200_000), 3: (n, 0), 4: (n + 3, n), 5: (49, 0), 6: (49, 0), 7: (51, 50)}


def test_spans_in_references(odd, none, spark, monkeypatch):
    """Against every window of the references, in one shard and in many."""
    rows = [r for r in odd_rows() if r[0] is not None and r[1] is not None]
    references = [r[1] for r in rows[4:12]] + ["too short", None, rows[5][1] + " and more"]
    windows = set()
    for t in references:
        w = WORD.findall(t or "")
        windows |= {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    want = {}
    for i, t, *_ in rows:
        w = WORD.findall(t)
        if its := {j for k in range(len(w) - 49) if tuple(w[k : k + 50]) in windows for j in range(k, k + 50)}:
            want[i, len(w)] = its
    docs, refs = substring_dedup._keyed(odd).where("doc_id is not null and text is not null"), spark.createDataFrame([(t,) for t in references], "text string")
    for bound in (substring_dedup.SHARD_WORDS, 6400):
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", bound)
        found = {}
        for r in substring_dedup.spans_in(docs, refs).collect():
            found.setdefault(r.doc_id, set()).update(j for p in r.spans for j in range(p.s, p.e))
        assert {i: s for (i, _), s in want.items()} == found
    assert substring_dedup.spans_in(docs, refs.where("text is null")).count() == 0


def test_substring_stage(odd, none):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    cut = substring_dedup.remove_repeats(odd)
    assert cut.columns == odd.columns
    got = Counter((r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in cut.collect())
    want = Counter()
    for i, w, g in brute_removed(rows):
        left = " ".join(x for p, x in enumerate(w) if p not in g)
        if left or not g:
            want[i, left] += 1
    assert got == want and substring_dedup.remove_repeats(none).count() == 0


def test_substring_stage_cuts_once(spark):
    """A second call in the plan would give each task a second Python worker, which an executor's memory doesn't hold."""
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"{passage}\ta", 3), (2, f" x\n{passage} y ", 4), (3, passage, 5), (4, None, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "x y", 3), rows[3]]


def test_automaton():
    a = substring_dedup.Automaton([[b"x", b"y", b"x", b"z"]])
    assert a.matching([b"y", b"x", b"z", b"q", b"x", b"y", b"x", b"y"]) == [1, 2, 3, 0, 1, 2, 3, 2]
    assert substring_dedup.maximal_spans([0, 1, 2, 3, 0, 1, 2], 2) == [(1, 4), (5, 7)]

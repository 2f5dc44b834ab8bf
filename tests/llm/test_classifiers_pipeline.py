import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from repairlake.llm import queries, quality_classifier, toxicity
from repairlake.llm.common import table

from .conftest import odd_rows

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("make,column", [(quality_classifier.classify_quality, "quality"), (toxicity.classify_toxicity, "toxic")])
def test_defined_cases(odd, none, spark, make, column):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (99, 1)], f"doc_id bigint, {column} int")
    got = make(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd_rows())
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert make(none, labels).count() == 0
    assert {r.score for r in make(odd, labels.where("doc_id is null")).collect()} == {0.5}


def held_out(spark, name, column, sf):
    got = queries.QUERIES[name](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    y, s = np.array([r[column] for r in got]), np.array([r.score for r in got])
    order = s[y == 1][:, None] - s[y == 0][None]
    return (order > 0).mean() + (order == 0).mean() / 2, np.array([r.predicted for r in got]), y


def test_quality_on_held_out_rows(spark):
    auc, predicted, y = held_out(spark, "op8_naive_bayes_svm", "quality", LARGER)
    assert auc > 0.99 and (predicted == y).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    auc, predicted, y = held_out(spark, "op9_recurrent_toxicity", "toxic", LARGER)
    assert auc > 0.93 and predicted[y == 1].mean() > 0.7 and predicted[y == 0].mean() < 0.1


def test_log_ratios_and_the_least_hinge_loss():
    """Ratios by counting, and weights that no step in any direction betters (the problem is convex)."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)).astype(np.int32) for _ in range(40)]
    y = np.array([int(3 in r or rng.random() < 0.2) for r in rows])
    ratio = quality_classifier.log_ratio(rows, y)
    for j in range(13):
        held = [sum(j in r for r, label in zip(rows, y, strict=True) if label == k) + 1 for k in (0, 1)]
        assert ratio[j] == pytest.approx(np.log(held[1] / ((y == 1).sum() + 2)) - np.log(held[0] / ((y == 0).sum() + 2)))
    scale = ratio[:12]
    w, b = quality_classifier.dual_coordinate_descent(rows, scale, y, epochs=3000)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 12], sign = 1, np.where(y == 1, 1.0, -1.0)
    top = quality_classifier.C * 40 * 20 * np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    loss = lambda v: v @ v / 2 + (top * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = np.append(w, b)
    assert all(loss(best + d * s) > loss(best) - 1e-6 for d in rng.standard_normal((300, 13)) for s in (1e-3, 1e-1, 1))


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 3, 2 * toxicity.SIDE))
    keep: dict = {}
    out = net.logits(x, keep)
    up = rng.standard_normal(out.shape)
    grads, d_x = net.backward(keep, up)
    for name in ("wxf", "whr", "bxf", "u", "v", "w", "b"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        was, h = net.p[name][at], 1e-3
        net.p[name][at] = was + h
        more = (net.logits(x) * up).sum()
        net.p[name][at] = was - h
        less = (net.logits(x) * up).sum()
        net.p[name][at] = was
        assert grads[name][at] == pytest.approx((more - less) / (2 * h), rel=2e-2, abs=2e-3)
    assert d_x.shape == x.shape


def test_every_window_counts():
    assert toxicity.window_starts(10).tolist() == [0] and toxicity.window_starts(70).tolist() == [0, 16, 32, 38]
    net = toxicity.Network(0)
    (text,) = toxicity.word_inputs([" ".join(f"word{i * 37 % 11}x{i}" for i in range(70))])
    x = net.inputs(text)
    each = [net.logits(x[s : s + 32][:, None, :])[0] for s in (0, 16, 32, 38)]
    assert net.document_logits([text])[0] == pytest.approx(max(each), rel=1e-4)


def test_all_characters_of_a_word_count():
    """Runs of four bytes with a mark at either end, of words of any length, and the sum of their embeddings."""
    texts = ["a ab (Straßenbahnhaltestellenschild) x", None, "", " " + "y" * 300]
    got = list(toxicity.word_inputs(texts))
    assert [t.count.tolist() for t in got] == [[1, 1, 29, 1], [], [], [299]]
    other = list(toxicity.word_inputs(["a ab straßenbahnhalteStellenschilt X"]))[0]
    assert (got[0].word == other.word).tolist() == [True, True, False, True] and (got[0].grams != other.grams).sum() == 2  # those with the last byte
    net = toxicity.Network(0)
    first = got[0].first[2]
    want = net.p["char"][got[0].grams[first : first + 29]].sum(0) / np.sqrt(29)
    assert net.inputs(got[0], block=3)[2, toxicity.SIDE :] == pytest.approx(want, rel=1e-4)


def test_pipeline_stages_are_whole(spark):
    """Stage by stage against brute force, each on its own input."""
    import corpus_pipeline

    from .test_near_copies import brute_kept
    from .test_rules_and_dedup import WORD, brute_removed
    from repairlake.llm.quality_rules import judge

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    kept = spark.createDataFrame(corpus_pipeline.STAGES[0][1](spark, docs, "").collect(), docs.schema)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if judge(r.text)[6]}
    one = spark.createDataFrame(corpus_pipeline.STAGES[1][1](spark, kept, "").collect(), docs.schema)
    assert sorted(r.doc_id for r in one.collect()) == brute_kept([(r.doc_id, r.text) for r in kept.collect()])
    cut = spark.createDataFrame(corpus_pipeline.STAGES[2][1](spark, one, "").collect(), docs.schema)
    want = {i: " ".join(x for p, x in enumerate(w) if p not in g) for i, w, g in brute_removed([(r.doc_id, r.text) for r in one.collect()])}
    assert {r.doc_id: " ".join(WORD.findall(r.text)) for r in cut.collect()} == {i: t for i, t in want.items() if t}
    mixed = spark.createDataFrame(corpus_pipeline.STAGES[3][1](spark, cut, "").collect(), docs.schema)
    n = lambda df: sum(len(WORD.findall(r.text)) for r in df.collect())
    assert n(cut) - 20 <= n(mixed) <= n(cut)
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    assert n(packed) == n(mixed) == packed.agg(F.sum("n_words")).first()[0]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == packed.count()

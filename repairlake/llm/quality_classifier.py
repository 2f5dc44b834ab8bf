"""Naive Bayes support vectors for document quality.

Features are indicators of n-grams, hashed to 2^17 places: bytes (1 to 4), and word shapes (1 to 3; a
shape is the kinds of a word's first and last two characters and whether the word equals the one before).
How much of a text repeats itself (lines, 8-word windows) gives one indicator each of a few steps. Each
indicator is scaled by its class log-count ratio, a linear hinge-loss model is fitted to them by dual
coordinate descent, and its weights are drawn towards their mean size (the interpolation of the method).
Margins of three folds that a model has not seen give the logistic curve that turns a margin into a score.

The model is fitted on at most MAX_TRAIN labelled documents, those first in the order of a hash of doc_id, and of
a doc_id on one of its rows whose text has at most MAX_BYTES, so that what the driver holds is bounded; it has a fixed size and is broadcast. Scoring reads whole texts in one pass.

Defined cases: null and empty texts have no indicator and get the score of the bias alone. Labels that are
null or whose document is missing teach nothing; several labels of one doc_id count as the smallest. With
no label, or labels of one class, the score is their smoothed share. Repeated rows are scored one by one.
An empty table gives an empty result; lang, source and other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .wordhash import Batch, groups_of, ngrams

PLACES_BITS = 17
MAX_TRAIN, MAX_BYTES = 3000, 1 << 18
ALPHA, C, MIXED, EPOCHS, FOLDS = 1.0, 0.05, 0.5, 12, 3

_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 128 else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c.isdigit() else 5 + _b % 59
_U = np.uint64


def _place(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) + _U(salt)) * _U(0x9E3779B97F4A7C15) >> _U(64 - PLACES_BITS)).astype(np.int64)


def _steps(share: float) -> int:
    return 0 if share <= 0 else 1 if share <= 0.1 else 2 if share <= 0.3 else 3 if share <= 0.6 else 4


def indicators(texts: list[str | None]):
    """For each text the sorted places of its indicators, in order."""
    raws = [(t or "").encode() for t in texts]
    flags = np.zeros(1 << PLACES_BITS, bool)
    for i, j in groups_of(raws):
        batch = Batch(raws[i:j])
        first = _KIND[batch.raw[batch.starts]]
        last = _KIND[batch.raw[batch.ends - 1]]
        before = _KIND[batch.raw[np.maximum(batch.ends - 2, batch.starts)]] if len(batch.starts) else last
        same = np.concatenate(([False], batch.hashes[1:] == batch.hashes[:-1])) if len(batch.starts) else np.zeros(0, bool)
        shape = ((first * 64 + before) * 64 + last) * 2 + same
        for d, raw in enumerate(raws[i:j]):
            if not raw.strip():
                yield np.zeros(0, np.int32)
                continue
            a, z = batch.first[d], batch.stop[d]
            flags[:] = False
            for part in range(0, len(raw), 1 << 20):
                b = np.frombuffer(raw, np.uint8)[part : part + (1 << 20) + 3].astype(np.uint64)
                gram = b
                flags[_place(gram, 1)] = True
                for n in range(2, 5):
                    gram = gram[:-1] * _U(256) + b[n - 1 :]
                    if not len(gram):
                        break
                    flags[_place(gram, n)] = True
            s = shape[a:z].copy()
            s[:1] &= ~1
            gram = s.astype(np.uint64)
            flags[_place(gram, 11)] = True
            for n in (2, 3):
                if len(s) < n:
                    break
                gram = gram[:-1] * _U(1 << 20) + s[n - 1 :].astype(np.uint64)
                flags[_place(gram, 10 + n)] = True
            windows = ngrams(batch.hashes[a:z], 8)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            again = _steps(1 - len(np.unique(windows)) / len(windows)) if len(windows) else 5
            flags[_place(np.array([again], np.uint64), 21)] = True
            flags[_place(np.array([_steps(1 - len(set(lines)) / len(lines))], np.uint64), 22)] = True
            flags[_place(np.array([_steps(float(same[a + 1 : z].mean()) if z - a > 1 else 0)], np.uint64), 23)] = True
            yield np.flatnonzero(flags).astype(np.int32)


def log_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """The log-count ratio of each place between the classes."""
    counts = np.full((2, 1 << PLACES_BITS), alpha)
    for r, label in zip(rows, y.tolist(), strict=True):
        counts[label, r] += 1
    share = counts / np.array([[(y == 0).sum() + 2 * alpha], [(y == 1).sum() + 2 * alpha]])
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (on the scaled indicators) and bias of the linear model of least hinge loss."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha, sign = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    values = [scale[r] for r in rows]
    # each text has the length of one, so that long and short texts weigh alike
    values = [v / max(1e-9, float(np.sqrt(v @ v))) for v in values]
    top = c * len(rows) * np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * 20
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v, s = rows[i], values[i], sign[i]
            g = s * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - g / (float(v @ v) + 1), 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[r] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class Model:
    """weight: on plain indicators; margins are divided by the length of the scaled indicators."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 0):
        self.scale = log_ratio(rows, y)
        w, self.bias = dual_coordinate_descent(rows, self.scale, y, seed=seed)
        used = w != 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        self.weight = (MIXED * w + (1 - MIXED) * mean * np.sign(w)) * self.scale
        self.square = self.scale**2
        self.curve = (1.0, 0.0)

    def margin(self, row: np.ndarray) -> float:
        if not len(row):
            return self.bias
        return float(self.weight[row].sum() / max(1e-9, np.sqrt(self.square[row].sum()))) + self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.margin(row) + self.curve[1], -40, 40))))


class Share:
    """What is left where there is nothing to tell apart."""

    def __init__(self, y: np.ndarray):
        self.value = float(((y == 1).sum() + 1) / (len(y) + 2))

    def score(self, row: np.ndarray) -> float:
        return self.value


def logistic_curve(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that make margins of unseen texts probabilities, by Newton steps."""
    spread = float(margins.std()) or 1.0
    x = np.stack([margins / spread, np.ones(len(margins))], 1)
    # targets drawn in a little, as usual for such curves
    t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        b += np.clip(np.linalg.solve(h, x.T @ (t - p) - 1e-3 * b), -5, 5)
    return float(b[0] / spread), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray):
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return Share(y)
    model = Model(rows, y)
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[train].tolist())) < 2:
            continue
        part = Model([rows[i] for i in train], y[train])
        margins[test] = [part.margin(rows[i]) for i in test]
    model.curve = logistic_curve(margins, y)
    return model


def split_remainder(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, y) of the first labelled documents outside the held-out part, at most so many of either class
    together: of each doc_id one row, of texts of at most MAX_BYTES the one whose hash is smallest."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("y"))
    taught = known.where(split_remainder(F.col("doc_id")) != 2)
    order = taught.orderBy(F.xxhash64(F.col("doc_id"), F.lit(column)), "doc_id").limit(most)  # a bounded sample
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES)
    return mine.join(F.broadcast(order), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MAX_TRAIN):
    def rows(b: dict) -> dict:
        return {"doc_id": b["doc_id"], "y": b["y"], "places": [p.tobytes() for p in indicators(b["text"])]}

    got = arrow_map(labelled(docs, labels, column, most), rows, "doc_id long, y int, places binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.y, len(r.places)))
    return fit([np.frombuffer(r.places, np.int32) for r in got], np.array([r.y for r in got]))


def score_documents(docs: DataFrame, model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b: dict) -> dict:
        scores = [sent.value.score(r) for r in indicators(b["text"])]
        return {"doc_id": b["doc_id"], "score": scores}

    made = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double")
    held = F.coalesce(split_remainder(F.col("doc_id")) == 2, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, threshold: float = 0.7) -> DataFrame:
    return score_documents(docs, train(docs, labels, "quality", most), threshold)

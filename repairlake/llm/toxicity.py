"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of the word (hashed to 2^15 places, ASCII letters in lower case, punctuation
around it taken off) beside that of its characters: the embeddings of all runs of four bytes of the word with a
mark before and after it (2^15 places), added and divided by the root of their number. No part of a word is left out.
Windows of 32 words, each overlapping the next by half, go through a gated recurrent unit in either
direction; attention weighs the states of a window, and a linear unit gives its logit. All windows of
the whole text are scored, the last one ending with the text; a document's logit is its greatest.

Training sees documents' labels only: the greatest window of a toxic document is taught as toxic, the
greatest and a random one of a clean document as clean, so that the network finds which windows matter.
Embeddings start with the log-odds of their place. A fifth of the training documents sets the logistic
curve from logit to score. At most MAX_TOXIC and MAX_CLEAN labelled documents are used, those first in
the order of a hash of doc_id, and of a doc_id the first of its rows whose text has at most MAX_BYTES, so that
what the driver holds is bounded; the network has a fixed size and is broadcast.

Defined cases: null and empty texts, or those without words, have score 0. A text shorter than a window is
one shorter window. Labels that are null or whose document is missing teach nothing; several labels of one
doc_id count as the smallest. With no label, or labels of one class, the score is their smoothed share.
Repeated rows are scored one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .quality_classifier import Share, labelled, logistic_curve, split_remainder
from .wordhash import Batch, groups_of, hash_spans

PLACES = 1 << 15
#: Bytes of a run of characters.
RUN = 4
SPAN, STRIDE = 32, 16
HIDDEN, ATTEND, SIDE = 8, 8, 4
MAX_TOXIC, MAX_CLEAN = 1000, 2000
EPOCHS, RATE, MINI = 14, 0.01, 128

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Words:
    """The words of texts, one after another: the place of each, how many runs of RUN bytes it has, and their places."""

    def __init__(self, word: np.ndarray, count: np.ndarray, grams: np.ndarray):
        self.word, self.count, self.grams = word, count, grams
        self.first = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[:-1] if len(count) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.word)

    @staticmethod
    def joined(some: list[Words]) -> Words:
        if not some:
            return Words(np.zeros(0, np.uint16), np.zeros(0, np.int32), np.zeros(0, np.uint16))
        return Words(*(np.concatenate([getattr(x, c) for x in some]) for c in ("word", "count", "grams")))

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the runs of the words at these indices, and where each word's begin."""
        n = self.count[at].astype(np.int64)
        begin = np.cumsum(n) - n
        return self.grams[np.repeat(self.first[at] - begin, n) + np.arange(int(n.sum()))], begin


def _place(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.uint16)


def word_inputs(texts: list[str | None]):
    """The Words of each text."""
    raws = [(t or "").encode().translate(_LOWER) for t in texts]
    for i, j in groups_of(raws):
        batch = Batch(raws[i:j])
        s, e = batch.starts.copy(), batch.ends.copy()
        for _ in range(3):
            if len(s):
                e -= _MARK[batch.raw[e - 1]] & (e - s > 1)
                s += _MARK[batch.raw[s]] & (e - s > 1)
        word = _place(hash_spans(batch.raw, s, e), 1)
        count = np.maximum(e - s + 2 - RUN + 1, 1)  # with a mark before and after the word
        first = np.cumsum(count) - count
        at = np.repeat(s - 1 - first, count) + np.arange(int(count.sum()))
        begin, end, raw = np.repeat(s, count), np.repeat(e, count), np.concatenate((batch.raw, np.zeros(RUN, np.uint8)))
        value = np.zeros(len(at), np.uint64)
        for k in range(RUN):
            byte = np.where(at + k < begin, 1, np.where(at + k < end, raw[at + k], np.where(at + k == end, 2, 0)))
            value = value << np.uint64(8) | byte.astype(np.uint64)
        grams = _place(value, 3)
        ends = np.concatenate((first, [len(grams)]))
        for d in range(j - i):
            a, z = batch.first[d], batch.stop[d]
            yield Words(word[a:z], count[a:z].astype(np.int32), grams[ends[a] : ends[z]])


def window_starts(n: int) -> np.ndarray:
    if n <= SPAN:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - SPAN, STRIDE), n - SPAN))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, size=0.3: (rng.standard_normal(shape) * size).astype(np.float32)
        d, h = 2 * SIDE, HIDDEN
        self.p = {"word": draw(PLACES, SIDE, size=0.02), "char": draw(PLACES, SIDE, size=0.02), "u": draw(2 * h, ATTEND), "v": draw(ATTEND), "w": draw(2 * h), "b": np.full(1, -1, np.float32)}
        for side in ("f", "r"):
            self.p |= {f"wx{side}": draw(d, 3 * h), f"wh{side}": draw(h, 3 * h), f"bx{side}": np.zeros(3 * h, np.float32)}
        self.curve = (1.0, 0.0)

    def inputs(self, words: Words, block: int = 100_000) -> np.ndarray:
        """(words, 2 * SIDE) inputs of all words."""
        out = np.empty((len(words), 2 * SIDE), np.float32)
        for i in range(0, len(words), block):
            at = np.arange(i, min(i + block, len(words)))
            grams, begin = words.runs(at)
            out[at, :SIDE] = self.p["word"][words.word[at]]
            out[at, SIDE:] = np.add.reduceat(self.p["char"][grams], begin, axis=0) / np.sqrt(words.count[at, None], dtype=np.float32)
        return out

    def _unit(self, g: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (steps, batch, HIDDEN) of one direction over the inputs' gates (steps, batch, 3 * HIDDEN)."""
        steps, n, _ = g.shape
        h, wh = HIDDEN, self.p[f"wh{side}"]
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gh = state @ wh
            zr = _sigmoid(g[t, :, : 2 * h] + gh[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(g[t, :, 2 * h :] + r * gh[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, gh[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def logits(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: (steps, batch, 2 * SIDE). keep collects what backward() needs."""
        p = self.p
        sides = {s: [] if keep is not None else None for s in ("f", "r")}
        states = np.concatenate([self._unit(x @ p[f"wx{s}"] + p[f"bx{s}"], s, sides[s]) for s in ("f", "r")], 2)
        a = np.tanh(states @ p["u"])
        e = a @ p["v"]
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = (share[..., None] * states).sum(0)
        if keep is not None:
            keep.update(x=x, states=states, a=a, share=share, pooled=pooled, sides=sides)
        return pooled @ p["w"] + p["b"][0]

    def backward(self, keep: dict, up: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters besides the embeddings, and of x, from those of the logits."""
        p, h = self.p, HIDDEN
        x, states, a, share = keep["x"], keep["states"], keep["a"], keep["share"]
        g = {"w": keep["pooled"].T @ up, "b": np.array([up.sum()])}
        d_pool = up[:, None] * p["w"]
        d_share = (states * d_pool).sum(-1)
        d_e = share * (d_share - (share * d_share).sum(0))
        g["v"] = (a * d_e[..., None]).sum((0, 1))
        d_a = d_e[..., None] * p["v"] * (1 - a * a)
        g["u"] = np.einsum("tbi,tbj->ij", states, d_a)
        d_states = share[..., None] * d_pool + d_a @ p["u"].T
        d_x = np.zeros_like(x)
        for i, s in enumerate(("f", "r")):
            d_in, d_h = np.zeros((*x.shape[:2], 3 * h), np.float32), np.zeros((x.shape[1], h), np.float32)
            g[f"wh{s}"] = np.zeros_like(p[f"wh{s}"])
            for t, before, z, r, new, hn in reversed(keep["sides"][s]):
                d_h = d_h + d_states[t, :, i * h : (i + 1) * h]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (before - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_new], 1)
                d_gh = np.concatenate([d_z, d_r, d_new * r], 1)
                g[f"wh{s}"] += before.T @ d_gh
                d_h = d_h * z + d_gh @ p[f"wh{s}"].T
            g[f"wx{s}"] = np.einsum("tbi,tbj->ij", x, d_in)
            g[f"bx{s}"] = d_in.sum((0, 1))
            d_x += d_in @ p[f"wx{s}"].T
        return g, d_x

    def document_logits(self, texts: list[Words], block: int = 2048) -> np.ndarray:
        """The greatest window logit of each text; -inf where it has no words."""
        out = np.full(len(texts), -np.inf)
        full, short = [], {}
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        for d, t in enumerate(texts):
            if len(t) >= SPAN:
                full.append((d, window_starts(len(t)) + first[d]))
            elif len(t):
                short.setdefault(len(t), []).append(d)
        jobs = [(SPAN, np.concatenate([np.full(len(s), d) for d, s in full]), np.concatenate([s for _, s in full]))] if full else []
        jobs += [(n, np.array(ds), first[ds]) for n, ds in short.items()]
        if not jobs:
            return out
        x = self.inputs(Words.joined(texts))
        for steps, doc, start in jobs:
            for i in range(0, len(doc), block):
                at = start[i : i + block][None, :] + np.arange(steps)[:, None]
                np.maximum.at(out, doc[i : i + block], self.logits(x[at]).astype(np.float64))
        return out

    def scores(self, texts: list[Words]) -> np.ndarray:
        """0 where a text has no words."""
        m = self.document_logits(texts)
        return np.where(np.isfinite(m), 1 / (1 + np.exp(-np.clip(self.curve[0] * np.where(np.isfinite(m), m, 0) + self.curve[1], -40, 40))), 0.0)


def _start_embeddings(net: Network, texts: list[Words], y: np.ndarray) -> None:
    """The first component of each embedding: the log-odds of toxic documents among those that hold its place."""
    for name, of, weight in (("word", "word", 1.0), ("char", "grams", 0.5)):
        n = np.zeros((2, PLACES))
        for t, label in zip(texts, y.tolist(), strict=True):
            n[label, np.unique(getattr(t, of))] += 1
        share = (n + 1) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 2)
        odds = np.clip(np.log(share[1] / share[0]), -1, 4) * (n.sum(0) >= 3)
        net.p[name][:, 0] += odds.astype(np.float32) * weight


def _scatter(net: Network, squares: dict, name: str, places: np.ndarray, grads: np.ndarray) -> None:
    """One adaptive step of the embeddings at places."""
    rows, back = np.unique(places, return_inverse=True)
    total = np.stack([np.bincount(back, grads[:, c], len(rows)) for c in range(SIDE)], 1).astype(np.float32)
    squares[name][rows] += (total * total).mean(1)
    net.p[name][rows] -= 0.02 * total / np.sqrt(squares[name][rows])[:, None]


def fit(texts: list[Words], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0):
    y = np.asarray(y, np.int64)
    some = [i for i, t in enumerate(texts) if len(t)]
    texts, y = [texts[i] for i in some], y[some]
    if len(set(y.tolist())) < 2:
        return Share(y)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    apart = order[: len(y) // 5] if min((y == 1).sum(), (y == 0).sum()) >= 20 else order[:0]
    own = np.setdiff1d(order, apart)
    net = Network(seed)
    _start_embeddings(net, [texts[i] for i in own], y[own])
    words = Words.joined(texts)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    starts = [window_starts(n) for n in size.tolist()]

    def window(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(SPAN, windows) indices of words; a text shorter than a window goes round."""
        return base[doc] + (at + np.arange(SPAN)[:, None]) % size[doc]

    first = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "char")}
    squares = {k: np.full(len(net.p[k]), 1e-3, np.float32) for k in ("word", "char")}
    step = 0
    balance = np.where(y == 1, 0.5 / (y[own] == 1).mean(), 0.5 / (y[own] == 0).mean())
    doc = np.concatenate([np.full(len(starts[i]), i) for i in own])
    at = np.concatenate([starts[i] for i in own])
    begin = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
    for _ in range(epochs):
        value, x = np.empty(len(doc), np.float32), net.inputs(words)
        for i in range(0, len(doc), 2048):
            value[i : i + 2048] = net.logits(x[window(doc[i : i + 2048], at[i : i + 2048])])
        chosen: list[tuple[int, int]] = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            chosen.append((int(doc[a]), int(at[a + int(value[a:b].argmax())])))
            if y[doc[a]] == 0:
                chosen.append((int(doc[a]), int(at[rng.integers(a, b)])))
        rng.shuffle(chosen)
        for i in range(0, len(chosen), MINI):
            part = np.array(chosen[i : i + MINI])
            its = window(part[:, 0], part[:, 1])
            flat = its.ravel()
            grams, runs = words.runs(flat)
            root = np.sqrt(words.count[flat], dtype=np.float32)[:, None]
            taken = np.concatenate([net.p["word"][words.word[flat]], np.add.reduceat(net.p["char"][grams], runs, axis=0) / root], 1)
            keep: dict = {}
            out = net.logits(taken.reshape(*its.shape, -1), keep)
            up = ((_sigmoid(out) - y[part[:, 0]]) * balance[part[:, 0]] / len(part)).astype(np.float32)
            grads, d_x = net.backward(keep, up)
            step += 1
            for k, g in grads.items():
                m, v = first[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            d_x = d_x.reshape(len(flat), -1)
            _scatter(net, squares, "word", words.word[flat], d_x[:, :SIDE])
            _scatter(net, squares, "char", grams, np.repeat(d_x[:, SIDE:] / root, words.count[flat], axis=0))
    judge = apart if len(apart) and len(set(y[apart].tolist())) == 2 else own
    net.curve = logistic_curve(net.document_logits([texts[i] for i in judge]), y[judge])
    return net


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic"):
    def rows(b: dict) -> dict:
        some = list(word_inputs(b["text"]))
        return {"doc_id": b["doc_id"], "y": b["y"], **{c: [getattr(w, c).tobytes() for w in some] for c in ("word", "count", "grams")}}

    got = []
    for of, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)):
        some = labelled(docs, labels.where(F.col(column) == of), column, most)
        got += arrow_map(some, rows, "doc_id long, y int, word binary, count binary, grams binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.y, len(r.word)))
    return fit([Words(np.frombuffer(r.word, np.uint16), np.frombuffer(r["count"], np.int32), np.frombuffer(r.grams, np.uint16)) for r in got], np.array([r.y for r in got]))


def score_documents(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b: dict) -> dict:
        texts = list(word_inputs(b["text"]))
        its = sent.value
        scores = [its.value] * len(texts) if isinstance(its, Share) else its.scores(texts).tolist()
        return {"doc_id": b["doc_id"], "score": scores}

    made = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double", at_once=200)
    held = F.coalesce(split_remainder(F.col("doc_id")) == 2, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return score_documents(docs, train(docs, labels), threshold)

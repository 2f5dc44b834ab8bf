"""Vectorised 64-bit word and n-gram hashes of whole batches of texts.

The hashes route and bucket; nothing takes two words for equal because their hashes are.
"""

from __future__ import annotations

import numpy as np

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a byte array."""
    inside = np.concatenate(([False], ~_GAP[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each (adjacent or separate, ordered, non-empty) span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    power = _powers(int(size.max()))
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18  # spans at a time: what is held beside raw is bounded
    with np.errstate(over="ignore"):
        for i in range(0, len(starts), step):
            s, e, n = starts[i : i + step], ends[i : i + step], size[i : i + step]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            value = raw[place + np.repeat(s, n)].astype(np.uint64) + _U(1)
            out[i : i + step] = np.add.reduceat(value * power[place], first)
    return mix(out)


class Batch:
    """The words of several texts in one array: hashes, and for each text its first word and its end."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = word_spans(self.raw)
        self.hashes = hash_spans(self.raw, self.starts, self.ends)
        at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.stop = np.searchsorted(self.starts, at)
        self.first = np.concatenate(([0], self.stop[:-1])) if len(texts) else self.stop


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes."""
    k = len(h) - n + 1
    if k < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _U(_BASE) + h[i : i + k]
    return mix(out)


def groups_of(texts: list, most: int = 1 << 20):
    """Index ranges of texts whose bytes together stay below most (or are one text)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)

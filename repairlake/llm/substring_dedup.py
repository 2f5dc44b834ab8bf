"""Substring deduplication with suffix automata of reference shards.

A window is so many consecutive words. A word goes if a window over it also starts in a document with a
smaller doc_id; all windows are judged on the input.

1. Each window has an anchor, the 8-word shingle of least hash in it, so equal windows have equal anchors.
   A document gives one row for each run of windows of one anchor (at most RUN of them), about one in 22
   words, and no more in texts that repeat themselves.
2. Only anchors of two or more documents matter. Of each, the words of such a run in the document of
   smallest doc_id are the reference.
3. The references that most runs meet make up a shard whose words and bytes are bounded: one suffix
   automaton of them all is broadcast, and documents stream past it as they are cut.
4. The other references together grow with the corpus and can't be broadcast. They and the passages left
   meet in a join on the anchor, which Spark can split where an anchor is frequent; each task builds the
   automata of its references, its share being its shard.
   In both, matching statistics of at least a window make up the spans to remove.
5. Windows that are not in the reference of their anchor are compared among themselves by a 128-bit
   digest of their words, the least doc_id of each being found by aggregation. So the result is exact.

spans_in() is the operator against references of one's own (a benchmark, say): their automata are broadcast
shard by shard, however many these are.

A fixed bitmap of 2 MB tells which documents can have such passages; the others are not shuffled.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing. A null
doc_id is compared with nothing: the row keeps all its words and takes none from others. Rows of equal
doc_id are one document for the comparison (no window of one removes words of another) but get a row
each. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, split_by, staged, unstage
from .wordhash import Batch, groups_of, ngrams

WINDOW, ANCHOR, RUN = 50, 8, 64
#: A shard that is broadcast: words, bytes, references, and the runs of windows that a reference must meet to be in it.
SHARD_WORDS, SHARD_BYTES, SHARD_REFERENCES, MET = 100_000, 2 << 20, 1500, 32
#: Bytes of passages at a time.
AT_A_TIME = 4 << 20


def window_anchors(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window start of a sequence of word hashes, the place of its anchor."""
    g = ngrams(h, k)
    width = window - k + 1
    n = len(g) - width + 1
    out = np.empty(max(0, n), np.int64)
    step = 1 << 22
    for at in range(0, n, step):
        part = g[at : min(at + step, n) + width - 1]
        low = (part & ~np.uint64((1 << 23) - 1)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        m = min(step, n - at)
        low = np.minimum(low[:m], low[width - span : width - span + m])
        out[at : at + m] = (low & np.uint64((1 << 23) - 1)).astype(np.int64) + at
    return out


def anchor_rows(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, th, a, lo, hi): windows starting at words lo to hi of that text have the anchor a."""

    def rows(b: dict) -> dict:
        raw = [t.encode() for t in b["text"]]
        got: dict[str, list] = {c: [] for c in ("doc_id", "th", "a", "lo", "hi")}
        ids, ths = np.array(b["doc_id"], np.int64), np.array(b["th"], np.int64)
        for i, j in groups_of(raw):
            batch = Batch(raw[i:j])
            h = batch.hashes
            at = window_anchors(h, window, k)
            if not len(at):
                continue
            doc = np.searchsorted(batch.stop, np.arange(len(at)), "right")
            inside = np.arange(len(at)) + window <= batch.stop[np.minimum(doc, j - i - 1)]
            value, place = ngrams(h, k)[at].view(np.int64), np.arange(len(at))
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])))
            run = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % RUN == 0)
            end = np.concatenate((run[1:], [len(at)])) - 1
            run, end = run[inside[run]], end[inside[run]]
            d, first = doc[run], batch.first[doc[run]]
            got["doc_id"].append(ids[i + d])
            got["th"].append(ths[i + d])
            got["a"].append(value[run])
            got["lo"].append((run - first).astype(np.int32))
            got["hi"].append((end - first).astype(np.int32))
        return {c: np.concatenate(v) if v else [] for c, v in got.items()}

    return arrow_map(docs, rows, "doc_id long, th long, a long, lo int, hi int")


class Automaton:
    """The suffix automaton of sequences of words. A number that is no word ends each, so that no match spans two."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in (x for i, words in enumerate(sequences) for x in (*words, i)):
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """For each place, how many words up to and with it are the longest that a sequence holds."""
        out, state, n = [], 0, 0
        follow, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                n = length[state]
            to = follow[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def maximal_spans(matched: list[int], least: int) -> list[tuple[int, int]]:
    """The spans (start, end) of matches of at least that length, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for i, n in enumerate(matched):
        if n >= least:
            if out and i - n + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - n + 1, i + 1))
    return out


FOUND = "doc_id long, th long, s int, e int, digest binary"
PASSAGE = "a long, lo int, hi int, m long, words binary"

_shards: dict[str, Automaton] = {}


def _broadcast(spark: SparkSession, references: dict[int, bytes]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, references))


def _shard(sent) -> Automaton:
    """The automaton of the broadcast references, built once in a Python worker."""
    name, references = sent.value
    if name not in _shards:
        _shards.clear()
        _shards[name] = Automaton([words.split() for words in references.values()])
    return _shards[name]


def _judged(doc_id: int, th: int, lo: int, words: list[bytes], matched: list[int], own: bool, window: int, got: dict) -> None:
    """Puts rows of FOUND: the spans of a passage (from word lo on) that match, unless the reference is its own
    document's, and the digests of its windows that do not."""

    def put(*values):
        for c, v in zip(("doc_id", "th", "s", "e", "digest"), values, strict=True):
            got[c].append(v)

    if not own:
        for s, e in maximal_spans(matched, window):
            put(doc_id, th, lo + s, lo + e, None)
    for i in range(len(words) - window + 1):
        if matched[i + window - 1] < window:
            put(doc_id, th, lo + i, lo + i + window, hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest())


def _passages(docs: DataFrame, places: DataFrame, window: int, sent) -> DataFrame:
    """What the texts hold at places: rows of FOUND where the broadcast references (words by anchor) tell, and of
    PASSAGE else: windows lo to hi are words lo to hi + window."""
    names = [f.split()[0] for f in f"{FOUND}, {PASSAGE}".split(", ")]

    def rows(b: dict):
        got: dict[str, list] = {c: [] for c in names}
        size, held = 0, sent.value[1]

        def even():
            for c in names:
                got[c] += [None] * (len(got["doc_id"]) - len(got[c]))

        for doc_id, th, text, at in zip(b["doc_id"], b["th"], b["text"], b["at"], strict=True):
            words = text.encode().split()
            for p in at:
                lo, its = p["lo"], words[p["lo"] : p["hi"] + window]
                if p["a"] in held:
                    _judged(doc_id, th, lo, its, _shard(sent).matching(its), doc_id == p["m"], window, got)
                    even()
                    size += 100
                    continue
                whole = b" ".join(its)
                for c, v in (("doc_id", doc_id), ("th", th), ("a", p["a"]), ("lo", lo), ("hi", p["hi"]), ("m", p["m"]), ("words", whole)):
                    got[c].append(v)
                even()
                size += len(whole) + 100
                if size > AT_A_TIME:
                    yield got
                    got, size = {c: [] for c in names}, 0
        yield got

    at = places.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "lo", "hi", "m")).alias("at"))
    return arrow_map(docs.join(at, ["doc_id", "th"]), rows, f"{FOUND}, {PASSAGE}")


def _frequent(docs: DataFrame, places: DataFrame, shared: DataFrame, window: int) -> dict[int, bytes]:
    """The references (words by anchor) that most runs meet, within the bounds of a shard."""
    often = shared.where(F.col("c") >= MET).orderBy(F.desc("c"), "a").limit(SHARD_REFERENCES)
    often = staged(often.select("a", "c"), "often")
    own = places.where("doc_id = m").join(F.broadcast(often), "a").groupBy("a", "c").agg(F.min(F.struct("th", "lo", "hi", "doc_id")).alias("p"))
    own = staged(own.select("a", "c", "p.*"), "often-at")  # a row for each of at most SHARD_REFERENCES
    cut = lambda b: {"a": b["a"], "c": b["c"], "words": [b" ".join(t.encode().split()[lo : hi + window]) for t, lo, hi in zip(b["text"], b["lo"], b["hi"], strict=True)]}
    held = arrow_map(docs.join(F.broadcast(own), ["doc_id", "th"]).select("a", "c", "lo", "hi", "text"), cut, "a long, c long, words binary")
    out: dict[int, bytes] = {}
    words = size = 0
    for r in held.where(F.length("words") <= SHARD_BYTES // 64).dropDuplicates(["a"]).orderBy(F.desc("c"), "a").toLocalIterator():
        words, size = words + len(r.words.split()), size + len(r.words)
        if words > SHARD_WORDS or size > SHARD_BYTES:
            break
        out[r.a] = bytes(r.words)
    return out


def _streamed(passages: DataFrame, window: int) -> DataFrame:
    """Rows of FOUND of passages, each judged by the automaton of its anchor's reference."""
    reference = staged(passages.where("doc_id = m").groupBy("a").agg(F.min_by("words", F.struct("th", "lo")).alias("reference")), "reference")

    def rows(b: dict, shard: OrderedDict) -> dict:
        got: dict[str, list] = {c: [] for c in ("doc_id", "th", "s", "e", "digest")}
        for doc_id, th, lo, m, passage, reference in zip(b["doc_id"], b["th"], b["lo"], b["m"], b["words"], b["reference"], strict=True):
            words = passage.split()
            if passage == reference:
                matched = [*range(1, len(words) + 1)]
            else:
                automaton = shard.get(reference)
                if automaton is None:
                    automaton = shard[reference] = Automaton([reference.split()])
                    if len(shard) > 200:
                        shard.popitem(last=False)
                matched = automaton.matching(words)
            _judged(doc_id, th, lo, words, matched, doc_id == m, window, got)
        return got

    return arrow_map(passages.join(reference, "a").select("doc_id", "th", "lo", "m", "words", "reference"), rows, FOUND, OrderedDict)


def spans_in(docs: DataFrame, references: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, spans): where texts of docs (doc_id, th, text) hold window or more consecutive words of a text of
    references (text). These are dealt into shards of bounded size by a hash (a text above that is cut with window - 1
    words of overlap); the automaton of one after the other is broadcast, and all documents stream past each."""

    def cut(b: dict):
        for t in b["text"]:
            words, begin = (t or "").encode().split(), 0
            while len(words) - begin >= window:
                n, size = 0, 0
                while begin + n < len(words) and (n < window or n < SHARD_WORDS // 64 and size < SHARD_BYTES // 64):
                    size += len(words[begin + n]) + 1
                    n += 1
                yield {"words": [b" ".join(words[begin : begin + n])], "n": [n]}
                begin += n - window + 1

    parts = staged(arrow_map(references.select("text"), cut, "words binary, n long").dropDuplicates(["words"]), "references")
    total, size = parts.agg(F.sum("n"), F.sum(F.length("words"))).first()
    shards = max(1, -(-2 * (total or 0) // SHARD_WORDS), -(-2 * (size or 0) // SHARD_BYTES))
    found = None
    for i in range(shards):
        mine = parts.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == i).select("words").collect()  # a shard
        sent = _broadcast(docs.sparkSession, {k: bytes(r.words) for k, r in enumerate(mine)})

        def rows(b: dict, _: None, sent=sent) -> dict:
            spans = [maximal_spans(_shard(sent).matching((t or "").encode().split()), window) for t in b["text"]]
            return {"doc_id": b["doc_id"], "th": b["th"], "spans": [[{"s": s, "e": e} for s, e in its] for its in spans]}

        one = arrow_map(docs.select("doc_id", "th", "text"), rows, "doc_id long, th long, spans array<struct<s:int,e:int>>", lambda: None).where("size(spans) > 0")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, spans): where words of a row with that doc_id and text (by its hash th) are covered.
    docs: doc_id, th, text, neither id nor text null."""
    anchors = staged(anchor_rows(docs, window), "anchors")
    shared = anchors.groupBy("a").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most"), F.count("*").alias("c")).where("m < most").select("a", "m", "c")
    shared = staged(shared, "shared")  # a table of its own: only then can Spark split the join where an anchor is hot
    places = staged(anchors.join(shared.select("a", "m"), "a"), "places")
    unstage(anchors)
    near, _ = split_by(docs, places)
    sent = _broadcast(docs.sparkSession, _frequent(near, places, shared, window))
    passages = staged(_passages(near, places, window, sent), "passages")
    unstage(places)
    told = passages.where("words is null").select(*[f.split()[0] for f in FOUND.split(", ")])
    found = staged(_streamed(passages.where("words is not null"), window).unionByName(told), "spans")
    unstage(passages)
    rest = found.where("digest is not null")
    first = rest.groupBy("digest").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most")).where("m < most").select("digest", "m")
    first = staged(first, "first")
    more = rest.join(first, "digest").where("doc_id > m").select("doc_id", "th", "s", "e")
    spans = found.where("digest is null").select("doc_id", "th", "s", "e").unionByName(more)
    return staged(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "covered")


def _kept_mask(n: int, s: list | None, e: list | None) -> np.ndarray:
    """Which of n words no span from s to e covers."""
    edge = np.bincount(np.array(s or [], np.int64), minlength=n + 1) - np.bincount(np.array(e or [], np.int64), minlength=n + 1)
    return np.cumsum(edge[:n]) == 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def removal_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs."""
    keyed = _keyed(docs)
    spans = covered_spans(keyed.where("doc_id is not null and text is not null"), window)

    def rows(b: dict) -> dict:
        got: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")}
        none = [None] * len(b["text"])
        for doc_id, text, s, e in zip(b["doc_id"], b["text"], b.get("s", none), b.get("e", none), strict=True):
            words = (text or "").encode().split()
            n, removed = len(words), 0
            if s:
                keep = _kept_mask(n, s, e)
                removed = int(n - keep.sum())
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            for c, v in zip(got, (doc_id, n, removed, hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                got[c].append(v)
        return got

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    may, rest = split_by(keyed, spans)
    joined = may.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", F.col("spans.s").alias("s"), F.col("spans.e").alias("e"))
    return arrow_map(joined, rows, out).unionByName(arrow_map(rest.select("doc_id", "text"), rows, out))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words removed from text. Documents that lose nothing keep their text as it is;
    in others the separators before removed words go with them. Documents of which no word is left go.
    All columns stay, n_chars (where it is a column) is that of the new text."""
    keyed = _keyed(docs)
    spans = covered_spans(keyed.where("doc_id is not null and text is not null"), window)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([texts, starts, ends], ["text", "s", "e"]), 1000):
            some = []
            for text, s, e in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text is not None and s is not None:
                    parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
                    keep = _kept_mask(len(parts), s, e)
                    text = "".join(p for p, k in zip(parts, keep.tolist(), strict=True) if k).strip(" \t\n\x0b\x0c\r")
                some.append(text)
            out.append(pa.array(some, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    cut = cut.asNondeterministic()  # else the filter below gets a call of its own, and each task a second Python worker

    own = docs.withColumns({"_span_own": F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])})
    own = own.select("_span_own", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    may, rest = split_by(own, spans)
    found = may.join(spans.select("doc_id", "th", F.col("spans").alias("_spans")), ["doc_id", "th"], "left")
    made = found.withColumn("_cut", cut("text", F.col("_spans.s"), F.col("_spans.e"))).where("_spans is null or _cut <> ''")
    back = [F.col("text") if c == "text" else F.col(f"_span_own.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    changed = {"text": F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.col("_cut"))}
    if "n_chars" in docs.columns:
        at = F.col("_span_own")[f"c{docs.columns.index('n_chars')}"]
        changed["n_chars"] = F.when(F.col("_spans").isNull(), at).otherwise(F.length("_cut")).cast(docs.schema["n_chars"].dataType)
    return rest.select(*back).unionByName(made.select(*[changed[c].alias(c) if c in changed else b for c, b in zip(docs.columns, back, strict=True)]))

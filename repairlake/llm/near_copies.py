"""Near-duplicates by SimHash, verified on word shingles: one document of each group stays.

Candidates are documents whose fingerprints differ in at most 10 of 64 bits, found by the generalised
pigeonhole of simhash. The fingerprint is that of the set of words: an edit changes one word of it and five
shingles of five words, so that documents of a Jaccard similarity of 0.8 on shingles are 4 bits apart on the
average (9 with fingerprints of shingles). Sizes whose ratio rules the similarity out are in different
classes and do not meet. Each candidate pair is then verified: first by parities (each shingle flips one
bit; more odd bits than the similarity allows differences rule a pair out, and never wrongly), then on all
shingles. Only verified pairs link.

Keys of HOT or more documents name leaders, the documents with the most copies under them; those with LEAST
documents within reach, LEADERS at most, each have a group, of which a document is in one at most. The leader
is compared with its group first. Of what is then not in the group's largest component, each is compared
with all of the group, block by block, and only pairs that parities do not rule out leave a block. All
other pairs meet in a join on their keys. So a dense group gives a star and few of its pairs, and no candidate is left out.

What is missed are pairs whose fingerprints are further apart (README has the measured share). Equal sets
of shingles are one node. Shingles are compared as 64-bit hashes. A null or empty text has no shingles,
and such texts are one node; fewer words than a shingle give one shingle of all words. Words are in
ASCII lower case. Repeated rows are one; a null doc_id comes last; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, split_by, staged
from .components import components
from .simhash import _LOWER, KEY, apart, fitting, kept_rows, lookups, make_plan
from .wordhash import Batch, groups_of, ngrams

SHINGLE, PERCENT, MAX_BITS = 5, 80, 10
#: Documents from which on a key names a leader and a leader has a group, groups at most, and the rows of a block.
HOT, LEAST, LEADERS, BLOCK = 256, 64, 1000, 2048
_U = np.uint64


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate((h[:1] == h[:1], h[1:] != h[:-1]))]


def word_and_shingle_sets(texts: list[str | None], shingle: int):
    """For each text the distinct hashes of its words, and those of its shingles, ascending."""
    raws = [(t or "").encode().translate(_LOWER) for t in texts]
    for i, j in groups_of(raws):
        batch = Batch(raws[i:j])
        grams = ngrams(batch.hashes, shingle)
        for a, z in zip(batch.first.tolist(), batch.stop.tolist(), strict=True):
            h = batch.hashes[a:z]
            yield distinct(h), distinct(grams[a : z - shingle + 1] if z - a >= shingle else ngrams(h, len(h)) ^ _U(len(h)))


def set_fingerprint(h: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def parities(own: np.ndarray) -> bytes:
    """Of 4 places or more for each shingle (a power of two from 64 to 2^14), whether an odd number of them falls on it."""
    bits = min(14, max(6, math.ceil(math.log2(4 * max(1, len(own))))))
    return np.packbits(np.bincount((own >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def set_id(own: np.ndarray) -> int:
    """A hash of a set of hashes."""
    return int((own.sum(dtype=np.uint64) ^ _U(len(own))).view(np.int64)) if len(own) else 0


def size_class(size: int, percent: int) -> int:
    """Sets of at least that similarity are at most one class apart."""
    return int(math.log(max(1, size)) / math.log(100.01 / percent))


def described(docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(doc_id, th, node, fp, size, cls, odd) for each row of docs; th is a hash of the text."""

    def rows(b: dict) -> dict:
        got: dict[str, list] = {"doc_id": b["doc_id"], "th": b["th"]} | {c: [] for c in ("node", "fp", "size", "cls", "odd")}
        for words, own in word_and_shingle_sets(b["text"], shingle):
            for c, v in (("node", set_id(own)), ("fp", set_fingerprint(words)), ("size", len(own)), ("cls", size_class(len(own), percent)), ("odd", parities(own))):
                got[c].append(v)
        return got

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return arrow_map(keyed, rows, "doc_id long, th long, node long, fp long, size int, cls int, odd binary")


def differing_parities(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each pair of parities of any lengths the number of places that differ, at the shorter one's length."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():
        who = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        a, b = (np.frombuffer(b"".join([z[i] for i in who]), np.uint8).reshape(len(who), -1) for z in (x, y))
        while a.shape[1] != b.shape[1]:
            wide, narrow = (a, b) if a.shape[1] > b.shape[1] else (b, a)
            bits = np.unpackbits(wide, axis=1)
            a, b = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1), narrow
        out[who] = np.bitwise_count(a ^ b).sum(1)
    return out


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b: nodes) that reach the similarity, staged. nodes: (node, size, odd, first: doc_id and th of a row of it)."""

    def near(b: dict) -> dict:
        apart = differing_parities(b["x"], b["y"])
        fine = apart * (100 + percent) <= np.array(b["n"], np.int64) * (100 - percent)
        return {"a": np.array(b["a"], np.int64)[fine], "b": np.array(b["b"], np.int64)[fine]}

    side = lambda s, o: nodes.select(F.col("node").alias(s), F.col("size").alias(f"n{s}"), F.col("odd").alias(o))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
    left = staged(arrow_map(both, near, "a long, b long", at_once=5_000), "pairs")
    asked = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    where = nodes.join(asked, "node").select("node", F.col("first.doc_id").alias("own_id"), F.col("first.th").alias("own_th"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    may, _ = split_by(keyed, where.select(F.col("own_id").alias("doc_id"), F.col("own_th").alias("th")))  # else all texts would be shuffled
    texts = may.join(where, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))).select("node", "text").dropDuplicates(["node"])
    rows = lambda b: {"node": b["node"], "own": [own.view(np.int64) for _, own in word_and_shingle_sets(b["text"], shingle)]}
    own = staged(arrow_map(texts, rows, "node long, own array<bigint>", at_once=200), "shingles")
    met = left.join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    met = met.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("same"))
    return staged(met.where(F.col("same") * 100 >= (F.col("n") - F.col("same")) * percent).select("a", "b"), "links")


def leaders(nodes: DataFrame, hot: DataFrame, max_bits: int, percent: int) -> list:
    """(node, fp, size) of the leaders, those with the most nodes within reach first; LEADERS at most reach the driver."""
    named = hot.select("lead.*").groupBy("node", "fp", "size").agg(F.count("*").alias("keys"))
    some = named.orderBy(F.desc("keys"), "node").limit(4 * LEADERS).collect()
    sent = nodes.sparkSession.sparkContext.broadcast(_columns_of(some))

    def count(b: dict) -> dict:
        near = within(b, *sent.value, max_bits, percent).sum(0)
        at = np.flatnonzero(near)
        return {"i": at, "n": near[at]}

    if not some:
        return []
    n = {r.i: r.n for r in arrow_map(nodes.select("fp", "size"), count, "i int, n long", at_once=2_000).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [some[i] for i in sorted(n, key=lambda i: (-n[i], some[i].node)) if n[i] >= LEAST][:LEADERS]


def _columns_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r.fp for r in rows], np.int64), np.array([r["size"] for r in rows], np.int64)


def within(b: dict, fp: np.ndarray, size: np.ndarray, max_bits: int, percent: int) -> np.ndarray:
    """(rows of b, leaders): whether a leader is within reach and of a size that fits."""
    own, sizes = np.array(b["fp"], np.int64), np.array(b["size"], np.int64)
    near = np.bitwise_count((own[:, None] ^ fp[None]).view(np.uint64)) <= max_bits
    return near & (np.minimum(sizes[:, None], size) * 100 >= np.maximum(sizes[:, None], size) * percent)


def in_groups(nodes: DataFrame, of: list, max_bits: int, percent: int) -> DataFrame:
    """nodes (node, fp, size, cls) with w: the number of the first leader within reach, from 1, or 0."""
    sent = nodes.sparkSession.sparkContext.broadcast(_columns_of(of))

    def put(b: dict) -> dict:
        near = within(b, *sent.value, max_bits, percent)
        return {**b, "w": np.where(near.any(1), near.argmax(1) + 1, 0) if len(sent.value[0]) else np.zeros(len(b["fp"]), np.int64)}

    return staged(arrow_map(nodes.select("node", "fp", "size", "cls"), put, "node long, fp long, size int, cls int, w long", at_once=2_000), "grouped")


def blockwise(rows: DataFrame, max_bits: int, percent: int) -> DataFrame:
    """(a, b): pairs of a group w of rows (w, node, root, done, fp, size, odd), not both done and of different roots, that
    fingerprints and parities allow to be similar. Rows of a group are dealt into blocks, and each pair of blocks is a task's."""
    of_group = rows.groupBy("w").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(of_group, "w").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    carried = ["w", "node", "root", "fp", "size", "odd"]
    x = dealt.where("not done").select(*carried, F.col("own").alias("xb"), other.alias("yb"), F.lit(True).alias("asks"))
    y = dealt.select(*carried, F.col("own").alias("yb"), other.alias("xb"), F.lit(False).alias("asks"))

    def solve(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        got = {c: group.column(c).to_numpy() for c in ("node", "root", "fp", "size")}
        odd = group.column("odd").to_pylist()
        xi, yi = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: tuple[list, list] = ([], [])
        for at in range(0, len(xi), 128):
            i = xi[at : at + 128]
            near = (np.bitwise_count((got["fp"][i][:, None] ^ got["fp"][yi][None]).view(np.uint64)) <= max_bits) & (got["root"][i][:, None] != got["root"][yi][None])
            r, c = np.nonzero(near)
            a, b = i[r], yi[c]
            fine = differing_parities([odd[j] for j in a.tolist()], [odd[j] for j in b.tolist()]) * (100 + percent) <= (got["size"][a].astype(np.int64) + got["size"][b]) * (100 - percent)
            out[0].append(got["node"][a[fine]])
            out[1].append(got["node"][b[fine]])
        a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return x.unionByName(y).groupBy("w", "xb", "yb").applyInArrow(solve, "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of nodes of at least that similarity, whose components are those of all such candidates."""
    plan, hot = make_plan(nodes.select("node", "fp", "size", "cls", "w"), max_bits, spread=2, hot=HOT)
    of = leaders(nodes, hot, max_bits, percent)
    grouped = in_groups(nodes, of, max_bits, percent)
    i, q = (lookups(grouped, plan, probing).select(*KEY, *[F.col(c).alias(f"{s}_{c}") for c in ("node", "fp", "size", "w")]) for probing, s in ((False, "b"), (True, "a")))
    apart_from = (F.col("a_node") != F.col("b_node")) & ((F.col("a_w") == 0) | (F.col("a_w") != F.col("b_w")))
    met = q.join(i, KEY).where(apart_from & (apart("a_fp", "b_fp") <= max_bits) & fitting("a_size", "b_size", percent))
    met = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    if not of:
        return verified(staged(met.distinct(), "asked"), docs, nodes, percent, shingle)
    leader = F.element_at(F.array(*[F.lit(r.node) for r in of]), F.col("w").cast("int"))
    star = grouped.where("w > 0").withColumn("lead", leader).where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    found = verified(staged(met.unionByName(star).distinct(), "asked"), docs, nodes, percent, shingle)
    rooted = staged(grouped.where("w > 0").select("w", "node").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    sizes = rooted.groupBy("w", "root").agg(F.count("*").alias("n")).groupBy("w").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    main = staged(sizes.where("roots > 1").drop("roots"), "main")  # a row for each group
    rest = rooted.join(main, "w").join(nodes.select("node", "fp", "size", "odd"), "node").withColumn("done", F.col("root") == F.col("main"))
    left = staged(blockwise(rest, max_bits, percent).join(star, ["a", "b"], "left_anti"), "asked")
    return found.unionByName(verified(left, docs, nodes, percent, shingle))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without all but one row of each group: that of the smallest doc_id (nulls last), of rows that share it the
    one whose text has the smallest hash. All columns stay, whatever their names; identical rows are one."""
    own = staged(described(docs, percent, shingle), "described")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    same = [F.first(c).alias(c) for c in ("fp", "size", "cls", "odd")]
    nodes = staged(own.groupBy("node").agg(F.count("*").alias("w"), least, *same), "nodes")
    rooted = nodes.select("node", "first").join(components(links(docs, nodes, percent, shingle, max_bits)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return kept_rows(docs, staged(kept.select("first.doc_id", "first.th"), "kept"))

"""Nearest neighbours by shifted Hilbert curves.

1. Every distinct vector gets a place on each of several Hilbert curves, over seeded random projections to a
   few dimensions, each curve shifted by its own offset. Keys are range-partitioned and numbered, curve by curve.
2. The index is fitted to the recall asked for: SAMPLE queries (the first in the order of a hash) are compared
   with all vectors, and of the numbers of curves the one is taken whose window, wide enough to hold RECALL
   of these queries' true neighbours, has the least to score. Every row is indexed; the sample sets two numbers.
3. A query meets the vectors within that window of places of its own on every curve, block by block of the curve.
   Windows' candidates merge and are ranked by their score on the original vectors.

How wide windows must be depends on the vectors: on clustered ones they are a small part of the curve, on isotropic
ones most of it, and then the work is queries times vectors (README has figures). A table of at most LEAST distinct
vectors is one window, and the result exact.

A block's group holds BLOCK vectors and, salted, some thousands of queries. Equal vectors are one with its k + 1
smallest ids (no query needs more of them), found by a window limit that works before the shuffle.

Defined cases: a vector that is null, empty, all zero or holds a null or non-finite component takes no
part, nor does one of another length than the most frequent (the greater of equals). A null vec_id takes no
part. Rows of one vec_id are one candidate and one query, whose score is that of the nearest of its vectors; a
query never meets its own vec_id. An empty table gives an empty result. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, staged, unstage

K = 20
CURVES, DIMENSIONS, BITS = 6, 6, 10
RECALL, SAMPLE, LEAST = 0.95, 256, 1024
BLOCK, BLOCK_QUERIES = 4096, 4096
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates, each of so many bits."""
    x = cells.astype(np.int64).T.copy()
    d, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projections(length: int, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(curves, length, dimensions) seeded directions, and (curves, dimensions) shifts below one half."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((curves, length, dimensions)) / np.sqrt(length), rng.random((curves, dimensions)) / 2


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    return np.cumsum(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1] if len(a) else np.zeros(0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & good)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (length.d if length else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(gid, embedding, ids): each vector once with its k + 1 smallest ids, ascending."""
    marked = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    own = marked.groupBy("h1", "h2", "vec_id").agg(F.first("embedding").alias("embedding"))
    few = own.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    held = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return held.select(F.xxhash64("h1", "h2").alias("gid"), "embedding", "ids")


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def curve_places(vectors: DataFrame, length: int, curves: int = CURVES) -> DataFrame:
    """(curve, place, gid) of vectors (gid, embedding): their places on each curve, gapless from 0."""
    directions, shifts = projections(length, curves)

    def ends(b: dict) -> dict:
        at = np.einsum("nd,cdp->cnp", np.array(b["embedding"], np.float64), directions)
        return {"axis": list(range(curves * DIMENSIONS)), "low": at.min(1).ravel().tolist(), "high": at.max(1).ravel().tolist()} if len(b["gid"]) else {"axis": [], "low": [], "high": []}

    found = arrow_map(vectors.select("gid", "embedding"), ends, "axis int, low double, high double").groupBy("axis").agg(F.min("low"), F.max("high")).collect()
    low, high = np.zeros(curves * DIMENSIONS), np.ones(curves * DIMENSIONS)
    for axis, a, z in found:
        low[axis], high[axis] = a, z
    low, span = low.reshape(curves, 1, -1), np.maximum(high - low, 1e-30).reshape(curves, 1, -1)

    def keys(b: dict) -> dict:
        at = (np.einsum("nd,cdp->cnp", np.array(b["embedding"], np.float64), directions) - low) / span / 2 + shifts[:, None, :]
        cells = np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        return {"curve": np.repeat(np.arange(curves, dtype=np.int32), len(b["gid"])), "key": np.concatenate([hilbert_keys(c, BITS) for c in cells]), "gid": b["gid"] * curves}

    def number(b: dict, count: list) -> dict:
        from pyspark import TaskContext

        n = len(b["gid"])
        at = range(count[0], count[0] + n)
        count[0] += n
        return {"curve": b["curve"], "gid": b["gid"], "part": [TaskContext.get().partitionId()] * n, "inside": list(at)}

    keyed = arrow_map(vectors.select("gid", "embedding"), keys, "curve int, key long, gid long")
    order = ["curve", "key", "gid"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = staged(arrow_map(ranged, number, "curve int, gid long, part int, inside long", lambda: [0]), "ordered")
    counts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("inside").alias("low"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offset = counts.select("curve", "part", (before - F.col("low")).alias("offset"))
    return numbered.join(offset, ["curve", "part"]).select("curve", (F.col("offset") + F.col("inside")).alias("place"), "gid")


def true_neighbours(vectors: DataFrame, ids: np.ndarray, y: np.ndarray, k: int) -> DataFrame:
    """(query, gid): the k vectors (gid, embedding) of largest inner product with each of a few queries, by comparing all."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = sent.value
        best, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            gid, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            for i in range(0, len(gid), BLOCK):
                g = gid[i : i + BLOCK]
                s = np.where(g[None] == ids[:, None], -np.inf, y @ x[i : i + BLOCK].T)
                s, g = np.concatenate([best, s], 1), np.concatenate([who, np.broadcast_to(g, s.shape)], 1)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(s, at, 1), np.take_along_axis(g, at, 1)
        fine = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, fine.sum(1))), pa.array(who[fine]), pa.array(best[fine])], names=["query", "gid", "score"])

    each = vectors.select("gid", "embedding").mapInArrow(run, "query long, gid long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "gid")
    return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "gid")


def least_window(apart: np.ndarray, n: int, recall: float = RECALL, least: int = LEAST) -> tuple[int, int]:
    """apart: (pairs, curves) places between queries and their true neighbours. (curves, window) with the least to score
    of those that hold that share of the pairs."""
    best: tuple[float, int, int] | None = None
    for c in range(1, apart.shape[1] + 1):
        need = np.sort(apart[:, :c].min(1))
        w = min(n, max(least, int(need[int(np.ceil(recall * len(need))) - 1]) if len(need) else 0))
        scored = c * (2 * w / n - (w / n) ** 2)
        if best is None or scored < best[0]:
            best = (scored, c, w)
    return best[1], best[2]


def fitted(vectors: DataFrame, places: DataFrame, asked: DataFrame, n: int, k: int, recall: float = RECALL, least: int = LEAST) -> tuple[int, int]:
    """(curves, window) for the queries asked (gid) among n vectors."""
    if n <= least:
        return 1, n
    some = asked.orderBy(F.xxhash64("gid", F.lit("sample")), "gid").limit(SAMPLE)
    got = vectors.select("gid", "embedding").join(some, "gid").collect()  # SAMPLE rows at most
    if not got:
        return 1, least
    ids = np.array([r.gid for r in got], np.int64)
    pairs = true_neighbours(vectors, ids, np.array([r.embedding for r in got], np.float64), k)
    theirs = places.select("curve", "gid", "place")
    own = places.join(some, "gid").select(F.col("gid").alias("query"), "curve", F.col("place").alias("own"))
    found = pairs.join(theirs, "gid").join(own, ["query", "curve"]).select("query", "gid", "curve", F.abs(F.col("place") - F.col("own")).alias("apart"))
    curves, apart = places.agg(F.max("curve")).first()[0] + 1, {}
    for r in found.collect():  # SAMPLE * k * CURVES rows at most
        apart.setdefault((r.query, r.gid), [n] * curves)[r.curve] = r.apart
    return least_window(np.array(list(apart.values()), np.int64).reshape(-1, curves), n, recall, least)


def windows(vectors: DataFrame, places: DataFrame, asked: DataFrame, n: int, k: int, curves: int, window: int, block: int = BLOCK) -> DataFrame:
    """(query, gid, score): for each query asked (gid) the nearest, at most k for each block of a curve that its
    windows touch. vectors: (gid, embedding, ids)."""
    salts = max(1, -(-min(2 * window + block, asked.count()) // BLOCK_QUERIES))
    on = places.where(F.col("curve") < curves)
    own = vectors.select("gid", "embedding", F.col("ids")[0].alias("least")).join(on, "gid")
    told = own.select("curve", F.floor(F.col("place") / block).alias("block"), "place", "gid", "embedding", "least", F.lit(False).alias("asks"))
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    low, high = F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block), F.floor(F.least(F.col("place") + window, F.lit(n - 1)) / block)
    asking = own.join(asked, "gid").select("curve", F.explode(F.sequence(low, high)).alias("block"), "place", "gid", "embedding", "least", F.lit(True).alias("asks"), F.pmod(F.xxhash64("gid"), F.lit(salts)).cast("int").alias("salt"))

    def solve(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        x, place, gid, first = matrix(group.column("embedding")), group.column("place").to_numpy(), group.column("gid").to_numpy(), group.column("least").to_numpy()
        y, qp, qg = x[asks], place[asks], gid[asks]
        x, cp, cg, cl = x[~asks], place[~asks], gid[~asks], first[~asks]
        out: tuple[list, ...] = ([], [], [])
        for i in range(0, len(y) if len(x) else 0, 256):
            s = y[i : i + 256] @ x.T
            s[np.abs(qp[i : i + 256, None] - cp[None]) > window] = -np.inf
            m = min(k, len(x))
            floor = -np.partition(-s, m - 1, axis=1)[:, m - 1]
            # candidates that rounding could have put in another order, then their order
            row, col = np.nonzero((s >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]) & np.isfinite(s))
            score = np.concatenate([exact_scores(y[i + row[j : j + 50_000]], x[col[j : j + 50_000]]) for j in range(0, max(1, len(row)), 50_000)])
            order = np.lexsort((cl[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            fine = nth < m
            for o, v in zip(out, (qg[i + row[fine]], cg[col[fine]], score[fine]), strict=True):
                o.append(v)
        query, near, score = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"query": pa.array(query, pa.int64()), "gid": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    return told.unionByName(asking).groupBy("curve", "block", "salt").applyInArrow(solve, "query long, gid long, score double")


def nearest(vectors: DataFrame, every: int, k: int = K, recall: float = RECALL, least: int = LEAST, curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vec_id divisible by every."""
    rows = staged(usable(vectors), "vectors")
    first = rows.select(F.size("embedding").alias("d")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = staged(distinct_vectors(rows, k), "distinct")
    n = distinct.count()
    places = staged(curve_places(distinct, first.d, curves), "places")
    mine = F.xxhash64(F.xxhash64("embedding"), F.hash("embedding"))
    queries = staged(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), mine.alias("query")).distinct(), "queries")
    asked = staged(queries.select(F.col("query").alias("gid")).distinct(), "asked")
    used, window = fitted(distinct, places, asked, n, k, recall, least)
    found = staged(windows(distinct, places, asked, n, k + 1, used, window), "windows")
    unstage(places)
    once = found.groupBy("query", "gid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    near = once.join(distinct.select("gid", "ids"), "gid").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    each = near.select("query", F.explode("ids").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    top = staged(each.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1).drop("r"), "top")
    told = queries.join(top, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

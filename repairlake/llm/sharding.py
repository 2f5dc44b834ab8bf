"""Sharding by Karmarkar-Karp differencing.

Documents of equal text are one indivisible group. A partial partition is a vector of shard loads; two of
largest spread are combined over and over, the one's loads in descending order upon the other's in
ascending order, until one is left. Every task runs this over a block of groups, and the block vectors,
so many numbers for each block, are combined in the same way on the driver. A block has 2000 groups or
five times the square root of their number, whichever is more, so that both a block and the table of
blocks stay small. Law: bytes. A group larger than a shard's share has a shard nearly to itself.

Slots are gapless in each shard: rows of a shard are numbered inside hash ranges of doc_id, and a range
begins where the counts of those before it end. No task holds a whole shard.

Defined cases: a null text counts as the empty one (size 16, crc32 0, one group with empty texts). A null
doc_id is sharded like any other. Repeated rows get a slot each. An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage

SHARDS, OVERHEAD = 40, 16
BLOCK_GROUPS = 2000
SLOT_ROWS = 4000


def difference(vectors: list[np.ndarray], k: int) -> list[np.ndarray]:
    """For each vector of at most k loads, the shard of each of its places, by largest differencing."""
    if not vectors:
        return []
    nodes: list[tuple[int, int, np.ndarray]] = []
    heap: list[tuple[float, int, int]] = []
    state: list[np.ndarray] = []
    orders: list[np.ndarray] = []
    for i, v in enumerate(vectors):
        full = np.zeros(k)
        full[: len(v)] = v
        order = np.argsort(-full, kind="stable")
        orders.append(order)
        state.append(full[order])
        heap.append((-(state[i][0] - state[i][-1]), i, i))
    heapq.heapify(heap)
    n = len(vectors)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = state[a] + state[b][::-1]
        order = np.argsort(-both, kind="stable")
        nodes.append((a, b, order))
        state.append(both[order])
        state[a] = state[b] = None  # type: ignore[call-overload]
        new = n + len(nodes) - 1
        heapq.heappush(heap, (-(state[new][0] - state[new][-1]), new, new))
    shard: list = [None] * (n + len(nodes))
    shard[heap[0][2]] = np.arange(k)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, order = nodes[i]
        at = shard[n + i]
        left = np.empty(k, np.int64)
        left[order] = at
        shard[a], shard[b], shard[n + i] = left, left[::-1].copy(), None
    out = []
    for i, v in enumerate(vectors):
        place = np.empty(k, np.int64)
        place[orders[i]] = shard[i]
        out.append(place[: max(1, len(v))])
    return out


def place_groups(groups: DataFrame, k: int, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """groups (gh, size, crc, n) with a shard for each."""
    n = groups.count()
    most = max(block_groups, int(5 * math.sqrt(n)))
    blocks = max(1, -(-n // most))

    def solve(pdf):
        pdf = pdf.assign(bytes=pdf["size"] * pdf["n"]).sort_values(["bytes", "gh"], ascending=[False, True])
        pdf["local"] = [int(p[0]) for p in difference([np.array([b], float) for b in pdf["bytes"]], k)]
        return pdf[["gh", "size", "crc", "block", "local", "bytes"]]

    schema = "gh string, size long, crc long, block int, local int, bytes long"
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("gh", "size"), F.lit(blocks)).cast("int"))
    placed = staged(dealt.groupBy("block").applyInPandas(solve, schema), "placed")
    loads = np.zeros((blocks, k))
    for r in placed.groupBy("block", "local").agg(F.sum("bytes").alias("b")).collect():
        loads[r.block, r.local] = r.b
    found = difference(list(loads), k)
    table = groups.sparkSession.createDataFrame([(b, i, int(s)) for b, places in enumerate(found) for i, s in enumerate(places)], "block int, local int, shard int")
    return placed.join(table, ["block", "local"]).select("gh", "size", "crc", "shard")


def shard_documents(docs: DataFrame, k: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.md5(text).alias("gh")),
        "sizes",
    )
    groups = staged(rows.groupBy("gh", "size", "crc").agg(F.count("*").alias("n")), "groups")
    shards = staged(place_groups(groups, k), "shards")
    unstage(groups)
    ranges = max(1, -(-rows.count() // (k * SLOT_ROWS)))
    own = staged(rows.join(shards, ["gh", "size", "crc"]).withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")), "sharded")
    counts = own.groupBy("shard", "range").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    offset = counts.select("shard", "range", before.alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "gh"))
    return own.join(offset, ["shard", "range"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("offset") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

"""Connected components over an edge table, by hooking to the smallest neighbour and pointer jumping.

Nothing is collected: every round is a few equi-joins and minimum aggregations (combined before the
shuffle, so that a node of high degree costs each task one row), and each round's tables are staged in
the shared folder. The rounds needed grow with the logarithm of the number of nodes. What is left of the
edges, once it is FEW, is solved by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, unstage

FEW = 15_000


def _solved(edges: DataFrame) -> DataFrame:
    """(u, p): each node of at most FEW edges (u, v) that is not the smallest of its component, and that one."""

    def rows(b: dict) -> dict:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for u, v in zip(b["u"], b["v"], strict=True):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
        found = [(x, find(x)) for x in list(root)]
        return {"u": [x for x, p in found if x != p], "p": [p for x, p in found if x != p]}

    # one row for all, as a task may get its edges in several batches
    whole = edges.coalesce(1).agg(F.collect_list("u").alias("u"), F.collect_list("v").alias("v"))
    flat = lambda b: rows({c: [x for some in b[c] for x in some] for c in ("u", "v")})
    return arrow_map(whole, flat, "u long, p long")


def _hooked(edges: DataFrame) -> DataFrame:
    """(u, p), staged: each node with a smaller neighbour, and the end of the path of smallest neighbours from it."""
    up = staged(edges.groupBy("u").agg(F.min("v").alias("p")), "hooks")
    while True:  # each node's pointer doubles its reach until all point to a root
        over = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = staged(up.join(over, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
        unstage(up)
        up = jumped.select("u", "p")
        if jumped.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) that is not the smallest of its component, and that smallest
    one. Loops, repeated edges and either direction are allowed; edges with a null end are none."""
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    left = staged(flat.distinct(), "edges")
    label: DataFrame | None = None
    while n := left.count():
        last = n <= FEW
        up = staged(_solved(left), "hooks") if last else _hooked(left)
        if label is None:
            label = up
        else:
            over = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            moved = label.join(over, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
            label = staged(moved.unionByName(up.join(label.select("u"), "u", "left_anti")), "labels")
        if last:
            break
        to_u, to_v = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = left.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        nxt = staged(moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        unstage(left)
        left = nxt
    if label is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return label.select(F.col("u").alias("node"), F.col("p").alias("root"))

"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into m parts, correlated bits together. If two fingerprints differ in at most r
bits and thresholds t_1..t_m, each at least -1, sum to r - m + 1, then some part i has at most t_i of
the differing bits. Every distinct fingerprint may choose its own thresholds: a dynamic program gives it
those with the least estimated number of candidates and probes. It then looks up all keys within t_i of
its own in part i, and candidates are verified on all 64 bits. A part with t_i = -1 is not looked up.

What reaches the driver has a fixed size: the 64 x 64 table of joint bit counts, a histogram of 4096
cells for each part, the sizes of the classes, and for each part the keys that hold at least 1/4096 of
all fingerprints (at most 4096, for the estimates alone). All these count all fingerprints.

A key with HOT or more fingerprints is hot. It has a leader, its fingerprint with the most documents; each
fingerprint within r bits of the leader is linked to it directly, and two such need no link of their own
under that key. The others are compared with all of the key, but under sub-keys: the bits outside the part
in r + 1 groups, one of which is equal in any two that differ in r bits at most. Hot keys are a table and
not a list on the driver. No link between different components is lost, and a dense group gives a star
and not all its pairs.

Defined cases: a null or empty text has fingerprint 0, which is linked like any other; fewer words than
a shingle give one shingle of all words. Equal fingerprints are one node, so copies cost one row. Repeated
rows each get a row. A null doc_id takes part but is no component's id unless all its ids are null. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, unstage
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: The cost of one lookup, shuffled and sorted, in candidates compared inside the join.
PROBE_COST = 100
CELL_BITS = 12
#: Fingerprints from which on a key is hot: well above what lookups of least cost meet by chance.
HOT = 1024

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    cuts = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp long) for each row of docs; th is a hash of the text."""
    rows = lambda b: {"doc_id": b["doc_id"], "th": b["th"], "fp": [fingerprint(t, shingle) for t in b["text"]]}
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), rows, "doc_id long, th long, fp long")


def joint_bits(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set among the fingerprints (64 x 64), and the number of those."""

    def rows(b: dict) -> dict:
        bits = np.unpackbits(np.array(b["fp"], np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both = (bits.T @ bits).astype(np.int64).ravel().tolist()
        return {"cell": [*range(4096), 4096], "n": [*both, len(bits)]}

    got = dict(arrow_map(distinct.select("fp"), rows, "cell int, n long", at_once=10_000).groupBy("cell").agg(F.sum("n").alias("n")).collect())
    return np.array([got.get(i, 0) for i in range(4096)], np.int64).reshape(64, 64), got.get(4096, 0)


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m groups of near equal size. Each group starts with the bit of the strongest ties to
    those left and takes the bit that is on average most correlated with what it holds."""
    if n < 2:
        return [list(range(i, 64, m)) for i in range(m)]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tie, 0)
    left, out = list(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (tie[b, group].mean(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def choose_parts(n: float, max_bits: int = MAX_BITS) -> int:
    """The number of parts with the least expected cost for lookups among n fingerprints of independent bits,
    thresholds being as even as they can be."""

    def cost(m: int) -> float:
        w, (each, more) = 64 // m, divmod(max_bits + 1, m)
        probes = sum(comb(w, k) for i in range(m) for k in range(each + (i < more)))
        return PROBE_COST * probes + probes * n / 2 ** (64 / m)

    return min(range(2, max_bits + 2), key=cost)


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, bit in enumerate(bits):
        out |= ((fp >> np.int64(bit)) & np.int64(1)) << np.int64(k)
    return out


class Plan:
    """The parts of the bits, and what lookups in each are estimated to meet."""

    def __init__(self, groups: list[list[int]], max_bits: int, share: float = 1.0, spread: int = 1):
        self.groups, self.max_bits, self.share, self.spread = groups, max_bits, share, spread
        self.cells = [np.zeros(1 << min(CELL_BITS, len(g))) for g in groups]
        self.heavy: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in groups]
        #: By part and threshold: the masks of exactly so many bits.
        self.masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(g)), t)], np.int64) for t in range(max_bits - len(groups) + 3) if t <= len(g)] for g in groups]
        #: By part: the other bits in max_bits + 1 groups.
        others = [[b for b in range(64) if b not in g] for g in groups]
        self.sub = [[o[i :: max_bits + 1] for i in range(max_bits + 1)] for o in others]

    def key(self, fp: np.ndarray, part: int) -> np.ndarray:
        return gathered(fp, self.groups[part])

    def cell(self, key: np.ndarray, part: int) -> np.ndarray:
        return key >> np.int64(max(0, len(self.groups[part]) - CELL_BITS))

    def heavy_at(self, key: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is heavy, and where among the heavy keys."""
        keys = self.heavy[part][0]
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, at

    def estimate(self, key: np.ndarray, part: int, t: int) -> np.ndarray:
        """Candidates of a lookup of all keys within t: heavy keys by their own count, others by their cell's mean."""
        g, cells = len(self.groups[part]), self.cells[part]
        inside = max(0, g - CELL_BITS)
        at = self.cell(key, part)
        found = cells[at] / 2.0**inside
        is_heavy, where = self.heavy_at(key, part)
        if len(self.heavy[part][0]):
            found = np.where(is_heavy, self.heavy[part][1][where], found)
        if t >= 1:
            near = sum(cells[at ^ (1 << b)] for b in range(min(CELL_BITS, g)))
            found = found + (near + inside * cells[at]) / 2.0**inside
        for k in range(2, t + 1):
            found = found + len(self.masks[part][k]) * cells.mean() / 2.0**inside
        return found * self.share

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """For each fingerprint its thresholds (rows: parts), by dynamic programming over the parts."""
        m, total = len(self.groups), self.max_bits - len(self.groups) + 1
        top = total + m - 1  # all others at -1
        best = {0: (np.zeros(len(fp)), [])}
        for part in range(m):
            key = self.key(fp, part)
            costs, probes = {-1: np.zeros(len(fp))}, 0
            for t in range(len(self.masks[part])):
                probes += len(self.masks[part][t])
                costs[t] = PROBE_COST * probes + self.estimate(key, part, t)
            nxt: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
            for s, (cost, chosen) in best.items():
                for t, c in costs.items():
                    to, so_far = s + t, cost + c
                    if to < -m or to > top:
                        continue
                    path = [*chosen, np.full(len(fp), t, np.int8)]
                    if to in nxt:
                        old, was = nxt[to]
                        less = so_far < old
                        nxt[to] = (np.where(less, so_far, old), [np.where(less, a, b) for a, b in zip(path, was, strict=True)])
                    else:
                        nxt[to] = (so_far, path)
            best = nxt
        return np.stack(best[total][1])


NODE = "node long, fp long, size int, cls int, w long"
ROWS = f"part int, bits long, {NODE}"
KEY = ["part", "bits", "cls"]


def lookups(nodes: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """ROWS of the index, or of the lookups, for nodes (the columns of NODE). A node is looked up in its own
    class and found in that and (spread 2) in the class below."""
    plan_at = nodes.sparkSession.sparkContext.broadcast(plan)
    carried = ("node", "size", "w")

    def rows(b: dict) -> dict:
        its, fp = plan_at.value, np.array(b["fp"], np.int64)
        own = {c: np.array(b[c], np.int64) for c in (*carried, "cls")}
        got: dict[str, list] = {c: [] for c in ("part", "bits", "fp", "cls", *carried)}
        chosen = its.thresholds(fp) if probing else None
        for part in range(len(its.groups)):
            key = its.key(fp, part)
            for t, masks in enumerate(its.masks[part]) if probing else [(0, np.zeros(its.spread, np.int64))]:
                who = np.flatnonzero(chosen[part] >= t) if probing else np.arange(len(fp))
                at = np.repeat(who, len(masks))
                got["part"].append(np.full(len(at), part, np.int32))
                got["bits"].append((key[who][:, None] ^ masks[None, :]).ravel())
                got["fp"].append(fp[at])
                got["cls"].append(own["cls"][at] - (0 if probing else np.tile(np.arange(its.spread), len(who))))
                for c in carried:
                    got[c].append(own[c][at])
        return {c: np.concatenate(v) for c, v in got.items()}

    return arrow_map(nodes.select("node", "fp", "size", "cls", "w"), rows, ROWS, at_once=5_000)


def make_plan(nodes: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None, spread: int = 1, hot: int = HOT) -> tuple[Plan, DataFrame]:
    """The plan for nodes (the columns of NODE) and the hot keys (part, bits, cls, lead)."""
    both, n = joint_bits(nodes)
    classes = {r.cls: r.k for r in nodes.groupBy("cls").agg(F.count("*").alias("k")).collect()}
    share = sum(k * sum(classes.get(c + i, 0) for i in range(spread)) for c, k in classes.items()) / max(1, n) ** 2
    plan = Plan(bit_groups(both, n, parts or choose_parts(n * share, max_bits)), max_bits, share, spread)
    lead = F.max_by(F.struct("node", "fp", "size"), F.struct("w", "node")).alias("lead")
    by_key = staged(lookups(nodes, plan, False).groupBy(*KEY).agg(F.count("*").alias("k"), lead), "keys")
    inside = F.element_at(F.array(*[F.lit(max(0, len(g) - CELL_BITS)) for g in plan.groups]), F.col("part") + 1)
    in_cells = by_key.groupBy("part", F.expr("1").alias("one"), F.call_function("shiftright", F.col("bits"), inside).alias("cell")).agg(F.sum("k").alias("k"))
    for r in in_cells.collect():
        plan.cells[r.part][r.cell] = r.k / spread
    heavy: list[list] = [[] for _ in plan.groups]
    for r in by_key.groupBy("part", "bits").agg(F.sum("k").alias("k")).where(F.col("k") >= spread * max(16, -(-n // 4096))).collect():
        heavy[r.part].append((r.bits, r.k // spread))
    plan.heavy = [tuple(np.array([x[i] for x in sorted(h)], np.int64) for i in range(2)) for h in heavy]
    found = staged(by_key.where(F.col("k") >= hot).select(*KEY, "lead"), "hot")
    unstage(by_key)
    return plan, found


def apart(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def fitting(x: str, y: str, percent: int) -> F.Column:
    """Whether sets of these sizes can have a Jaccard similarity of percent."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select(*KEY, *more, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in KEY and c not in more])


def light_and_heavy(nodes: DataFrame, plan: Plan, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """light: (a, b) nodes within reach that meet under keys that are not hot. heavy: the rows of hot keys (KEY, node,
    fp, size, w, lead), staged."""
    marked = [lookups(nodes, plan, probing).join(hot, KEY, "left") for probing in (False, True)]
    i, q = (_side(m.where("lead is null").drop("lead"), s) for m, s in zip(marked, ("b", "a"), strict=True))
    within = (apart("a_fp", "b_fp") <= plan.max_bits) & (F.col("a_node") != F.col("b_node"))
    met = q.join(i, KEY).where(within).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    heavy = marked[0].unionByName(marked[1]).where("lead is not null").dropDuplicates([*KEY, "node"])
    return met, staged(heavy, "heavy")


def starred(heavy: DataFrame, max_bits: int) -> DataFrame:
    """heavy with near: within reach of its key's leader (or the leader itself)."""
    return heavy.withColumn("lead_fp", F.col("lead.fp")).withColumn("near", apart("fp", "lead_fp") <= max_bits).drop("lead_fp")


def under_sub_keys(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (KEY, fp, ...) once for each group of the bits outside their part, with that (j) and its bits (sub)."""
    plan_at = rows.sparkSession.sparkContext.broadcast(plan)
    names, schema = rows.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def put(b: dict) -> dict:
        its, fp, part = plan_at.value, np.array(b["fp"], np.int64), np.array(b["part"])
        n, groups = len(fp), its.max_bits + 1
        sub = np.zeros((groups, n), np.int64)
        for p in np.unique(part).tolist():
            who = np.flatnonzero(part == p)
            for j in range(groups):
                sub[j, who] = gathered(fp[who], its.sub[p][j])
        return {c: b[c] * groups for c in names} | {"j": np.repeat(np.arange(groups, dtype=np.int32), n), "sub": sub.ravel()}

    return arrow_map(rows, put, f"{schema}, j int, sub long", at_once=5_000)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp, n: its documents) whose components are those of all pairs
    within max_bits."""
    nodes = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("size"), F.lit(0).alias("cls"), F.col("n").alias("w"))
    plan, hot_keys = make_plan(nodes, max_bits, parts)
    met, heavy = light_and_heavy(nodes, plan, hot_keys)
    near = starred(heavy, max_bits)
    star = near.where(F.col("near") & (F.col("node") != F.col("lead.node"))).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    return met.unionByName(star).unionByName(rest_of_hot(near.select(*KEY, "node", "fp", F.col("near").alias("done")), plan))


def rest_of_hot(rows: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): pairs within reach under a hot key of which not both are done."""
    open_keys = staged(rows.where("not done").select(*KEY).distinct(), "open-keys")
    sub = staged(under_sub_keys(rows.join(open_keys, KEY, "left_semi"), plan), "sub-keys")
    x, y = _side(sub.where("not done"), "a", "j", "sub"), _side(sub, "b", "j", "sub")
    within = (apart("a_fp", "b_fp") <= plan.max_bits) & (F.col("b_done") & (F.col("a_node") != F.col("b_node")) | (F.col("a_node") < F.col("b_node")))
    return x.join(y, [*KEY, "j", "sub"]).where(within).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _grouped(own: DataFrame, max_bits: int, parts: int | None) -> DataFrame:
    """(fp, root, first) for each distinct fingerprint of own; first: its row of least (doc_id, th), nulls last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    distinct = staged(own.groupBy("fp").agg(F.count("*").alias("n"), least), "distinct")
    root = components(links(distinct.select("fp", "n"), max_bits, parts)).select(F.col("node").alias("fp"), "root")
    return distinct.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text)."""
    own = staged(fingerprints(docs, shingle), "fingerprints")
    rooted = _grouped(own, max_bits, parts)
    least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    by_fp = staged(rooted.join(least, "root").select("fp", "component_id"), "components")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def kept_rows(docs: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of docs that left (doc_id, th of a row each) names: one for each, whole and with all columns."""
    its = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(its.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    told = left.select(F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th"))
    lone = keyed.join(told, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")), "left_semi")
    return lone.dropDuplicates(["id", "th"]).select("row.*")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id (nulls last), of rows that
    share it the one whose text has the smallest hash. All columns stay, whatever their names; identical rows are one."""
    own = staged(fingerprints(docs, shingle), "fingerprints")
    first = _grouped(own, max_bits, parts).groupBy("root").agg(F.min("first").alias("first"))
    return kept_rows(docs, staged(first.select("first.doc_id", "first.th"), "kept"))

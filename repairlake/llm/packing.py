"""Variable-capacity best-fit packing.

Several sequence lengths are permitted. A sequence of c words costs c + c^2 / SQUARE + BIN_COST: work that
grows with its words, attention that grows with their square, and a fixed part; so that short sequences
cost less a word, where pieces are short enough to fill them. For each block of pieces the lengths are
chosen jointly: every set of permitted lengths that can hold all pieces is tried, and the packing of least
total cost stays.

Within a set, pieces are placed in descending order of length, each into the open bin (of whatever capacity)
that it leaves the least room in. If it fits none, the bin size is opened that costs least for each word
it can be expected to hold: the piece, and of the room left as much as pieces still to be placed that are
small enough for it can fill. At last every bin is downsized to the smallest permitted length that holds
its contents. A document longer than the longest length is cut into full pieces and a rest; nothing is left out.

Rows are dealt into blocks of a few thousand by a hash of doc_id, text and the number of the copy among
identical rows, each block packed by one task: the packing depends on the rows alone, not on partitions.

Defined cases: a text without words (null, empty, blank) gives one piece of no words in no bin (null).
Rows with equal doc_id are packed one by one; identical rows differ in bins only. A null doc_id is packed
like any other. Ties in length go by doc_id (null last), then by a hash of the text, then by copy. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import arrow_map, n_words, staged

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its words, in words; and the words at which attention costs as much as all else.
BIN_COST, SQUARE = 32, 6144
BLOCK_ROWS, COPIES = 2000, 10_000


def cost(c: int, bin_cost: float = BIN_COST, square: float = SQUARE) -> float:
    """Of one sequence of c words."""
    return c + c * c / square + bin_cost


def fill(lengths: list[int], opened: tuple[int, ...], price: dict[int, float]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of pieces (descending) into bins of the opened capacities: (bin, offset) of each, words in each bin."""
    ahead = [0, *accumulate(reversed(lengths))][::-1]  # words from a piece on
    shorter = [-n for n in lengths]  # ascending
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    placed: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, least = 0, 0.0
            for c in opened:
                if c >= n:
                    small = ahead[max(i + 1, bisect_left(shorter, n - c))]  # words in later pieces that fit beside it
                    a_word = price[c] / (n + min(c - n, small))
                    if not room or a_word < least:
                        room, least = c, a_word
            b = len(used)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    return placed, used


def best_fit(lengths: list[int], capacities=CAPACITIES, bin_cost: float = BIN_COST, square: float = SQUARE) -> tuple[list[tuple[int, int]], list[int]]:
    """For pieces no longer than the largest capacity, in any order: (bin, offset) of each; the bins' lengths."""
    if not lengths:
        return [], []
    capacities = sorted(capacities)
    price = {c: cost(c, bin_cost, square) for c in capacities}
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ranked = [lengths[i] for i in order]
    best: tuple = ()
    for k in range(1, len(capacities) + 1):
        for opened in combinations(capacities, k):
            if opened[-1] < ranked[0]:
                continue
            places, used = fill(ranked, opened, price)
            sizes = [capacities[bisect_left(capacities, u)] for u in used]
            total = sum(price[c] for c in sizes)
            if not best or total < best[0]:
                best = (total, places, sizes)
    placed: list[tuple[int, int]] = [(-1, 0)] * len(lengths)
    for i, p in zip(order, best[1], strict=True):
        placed[i] = p
    return placed, best[2]


def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of a text of n words."""
    return [(s, min(most, n - s)) for s in range(0, n, most)]


SCHEMA = "doc_id long, piece int, start_word long, n_words int, bin_id long, bin_capacity int, bin_offset int"


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, th, n) with copy: identical rows are numbered from 0, many at a time."""
    counts = rows.groupBy("doc_id", "th", "n").agg(F.count("*").alias("c"))
    parts = counts.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(COPIES))))
    parts = parts.where("c <= %d" % COPIES).unionByName(parts.where("c > %d" % COPIES).repartition("doc_id", "th", "first"))
    return parts.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + COPIES, "c") - 1))).select("doc_id", "th", "n", "copy")


def pack(docs: DataFrame, capacities=CAPACITIES, bin_cost: float = BIN_COST, square: float = SQUARE, with_text: bool = False) -> DataFrame:
    """Rows of SCHEMA for the pieces of each row of docs (doc_id, text), with the words of the piece, joined
    by a space, as text where with_text is set."""
    capacities = tuple(sorted(capacities))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    base = staged(keyed.select("doc_id", "th", n_words(F.col("text")).alias("n")), "lengths")
    blocks = max(1, -(-base.count() // BLOCK_ROWS))

    own = SCHEMA.replace("doc_id long", "doc_id long, th long, copy long")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def solve(block: pa.Table) -> pa.Table:
        got = {c: block.column(c).to_pylist() for c in ("doc_id", "th", "copy", "n", "block")}
        order = sorted(range(block.num_rows), key=lambda i: (got["doc_id"][i] is None, got["doc_id"][i] or 0, got["th"][i], got["copy"][i]))
        cut = [(i, k, s, m) for i in order for k, (s, m) in enumerate(pieces(got["n"][i], capacities[-1]) or [(0, 0)])]
        some = [at for at, c in enumerate(cut) if c[3]]
        placed, sizes = best_fit([cut[at][3] for at in some], capacities, bin_cost, square)
        where = dict(zip(some, placed, strict=True))
        out: dict[str, list] = {c: [] for c in ("doc_id", "th", "copy", *names[1:])}
        for at, (i, k, s, m) in enumerate(cut):
            b, offset = where.get(at, (None, None))
            values = (got["doc_id"][i], got["th"][i], got["copy"][i], k, s, m, None if b is None else (got["block"][i] << 32) + b, None if b is None else sizes[b], offset)
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    kinds = [f.type for f in to_arrow_schema(_parse_datatype_string(own))]
    dealt = _numbered(base).withColumn("block", F.pmod(F.xxhash64("doc_id", "th", "copy"), F.lit(blocks)).cast("int"))
    made = dealt.groupBy("block").applyInArrow(solve, own)
    if not with_text:
        return made.select(*names)

    def cut_out(b: dict) -> dict:
        got: dict[str, list] = {c: [] for c in (*names, "text")}
        for doc_id, its, text in zip(b["doc_id"], b["pieces"], b["text"], strict=True):
            words = (text or "").encode().split()
            for p in its:
                for c in names[1:]:
                    got[c].append(p[c])
                got["doc_id"].append(doc_id)
                got["text"].append(b" ".join(words[p["start_word"] : p["start_word"] + p["n_words"]]).decode())
        return got

    of = made.groupBy("doc_id", "th", "copy").agg(F.collect_list(F.struct(*names[1:])).alias("pieces"))
    texts = keyed.dropDuplicates(["doc_id", "th"]).withColumnsRenamed({"doc_id": "own_id", "th": "own_th"})
    both = of.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")))
    return arrow_map(both.select("doc_id", "pieces", "text"), cut_out, SCHEMA + ", text string")


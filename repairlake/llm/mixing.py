"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source has a weight; together they share a total of words. Where a share is above the cap of so
many epochs of its source, the source stops there and the excess is shared by weight among the others,
until none is above. That fixed point has a closed form: with sources in ascending order of cap / weight,
the common level is (total - caps of those before) / (weights of the rest) at the first source whose own
cap / weight exceeds it. Every source is one row of that table.

A source's target in whole words is so many whole repetitions of all its documents and a rest. The rest
is a sample: documents in the order of a seeded hash, each taken once more until the rest is used up; the
one that crosses the end is taken in part (its first words). The running sums are made in two steps, over
4096 hash ranges of each source and then inside each range, so that no task holds a whole source.

Defined cases: a null source is a source of its own, ranked last. Null and empty texts have size 0 and
are not taken. Rows with equal ids stand side by side in the order; which of several identical rows comes
first does not matter to the result. A null id is ordered by the word null. Empty tables give empty
results. Other columns pass through; those beginning with _mix_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(by_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """by_source (source, source_size long) with weight and target added."""
    ranked = by_source.withColumn("_mix_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    at = F.pmod(F.col("_mix_rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (at + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("_mix_cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("_mix_cap").cast("double") / F.col("weight"), "_mix_rank")
    before = F.coalesce(F.sum("_mix_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total, rest = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (total - before).cast("double") / rest
    fits = caps.withColumn("_mix_level", F.when(level < F.col("_mix_cap").cast("double") / F.col("weight"), level))
    first = F.first("_mix_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(first * F.col("weight"), F.col("_mix_cap").cast("double")), F.col("_mix_cap").cast("double"))
    return fits.select("source", "source_size", "weight", target.alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_column: str = "doc_id") -> DataFrame:
    """rows (source, size long and any others) with source_size, target and taken added.
    rows is read three times: stage it if it is not a table."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    keyed = rows.withColumn("_mix_key", key).withColumn("_mix_range", F.substring("_mix_key", 1, 3))
    ranges = keyed.groupBy("source", "_mix_range").agg(F.sum("size").alias("_mix_sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_mix_sum").alias("source_size")), weights, max_epochs)
    goal = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0).cast("long"))
    plan = targets.select(F.col("source").alias("_mix_source"), "source_size", "target", whole.alias("_mix_whole"), (goal - whole * F.col("source_size")).alias("_mix_rest"))
    ahead = F.sum("_mix_sum").over(Window.partitionBy("source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_mix_sum")
    placed = ranges.withColumn("_mix_ahead", ahead)
    placed = placed.join(plan, placed.source.eqNullSafe(plan._mix_source)).drop("_mix_source")
    placed = placed.select(F.col("source").alias("_mix_source"), F.col("_mix_range").alias("_mix_at"), "_mix_ahead", "source_size", "target", "_mix_whole", "_mix_rest")
    own = keyed.join(placed, keyed.source.eqNullSafe(placed._mix_source) & (keyed._mix_range == placed._mix_at))
    inside = Window.partitionBy("source", "_mix_range").orderBy("_mix_key", id_column, "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_mix_ahead") + F.sum("size").over(inside) - F.col("size")
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_mix_rest") - start))
    taken = (F.col("_mix_whole") * F.col("size") + more).alias("taken")
    return own.select(*rows.columns, "source_size", "target", taken)


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs."""
    sized = staged(document_sizes(docs), "sizes")
    return mix(sized, **options).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition, and for the one document of a source
    that is taken in part its first words, joined by a space. All columns stay, n_chars (where it is a
    column) is that of the text."""
    sized = docs.withColumn("size", n_words(F.col("text"))) if "size" not in docs.columns else docs.withColumnRenamed("size", "_mix_own_size").withColumn("size", n_words(F.col("text")))
    took = mix(sized.withColumnsRenamed({c: f"_mix_own_{c}" for c in ("source_size", "target", "taken") if c in docs.columns}), **options)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    each = took.withColumn("_mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    left = F.col("taken") - (F.col("_mix_copy") - 1).cast("long") * F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, left.cast("int")), " ")
    cut = left < F.col("size")
    out = each.withColumn("_mix_cut", cut).withColumn("text", F.when(cut, part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_mix_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    back = {"size", "source_size", "target", "taken"} & set(docs.columns)
    return out.select(*[F.col(f"_mix_own_{c}").alias(c) if c in back else F.col(c) for c in docs.columns])

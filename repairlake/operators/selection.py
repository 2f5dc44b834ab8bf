"""Selecting cards and records, splits and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import landed
from .cards import repair_cards
from .scoring import first_by_id, high_quality


def top_cards(cards: DataFrame, k: int, order: str = "seq") -> DataFrame:
    """The k best: overall quality, score and number of test files descending, then as they came. Each task sends
    its own best k only."""
    return cards.orderBy(F.desc("quality.overall"), F.desc("quality.bug_fix_score"), F.desc(F.size("test_files")), order).limit(k)


def select_cards(records: DataFrame, k: int, min_quality: float = 0.0, order: str = "seq") -> DataFrame:
    """The k best cards of the first record of each id, among scored records of high quality."""
    first = first_by_id(records, order).where(high_quality(0.0))
    seq = first.select("id", F.col(order).alias("_seq"))
    cards = repair_cards(first, min_quality).where("quality.has_test_evidence and quality.has_source_patch")
    return top_cards(cards.join(seq, "id"), k, "_seq").drop("_seq")


def selected_records(records: DataFrame, cards: DataFrame) -> DataFrame:
    """All records (repeated ids stay) whose id is among the cards."""
    return records.join(cards.select(F.col("id").cast("string").alias("_id")).distinct(), F.col("id").cast("string") == F.col("_id"), "left_semi")


def not_completed(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks without a result row, for resuming."""
    return tasks.join(done.select(F.col(key).cast("string").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def numbered(rows: DataFrame, *order: str, into: str = "row") -> DataFrame:
    """rows numbered from 0 in an order, without one task holding them all: ranges are numbered inside and
    begin where the counts of those before end. The order should tell all rows apart."""
    # landed, because ranges drawn anew for the counts could differ from those of the rows
    ranged = landed(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(counts.select("_part", ahead.alias("_ahead"))), "_part").withColumn(into, F.col("_ahead") + inside - 1).drop("_part", "_ahead")


def shard(rows: DataFrame, index: int, count: int, *order: str) -> DataFrame:
    """The rows whose place in the order leaves index when divided by count."""
    if count <= 1:
        return rows
    return numbered(rows, *order, into="_row").where(F.col("_row") % count == index).drop("_row")


def hash_split(rows: DataFrame, share: float, *, key: str, seed: str = "split") -> DataFrame:
    """rows with split (validation, train): a seeded digest of the key below the share. It needs no order, no count
    and no shuffle, and a row keeps its side whatever else is in the table."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("split", F.when(place < F.lit(int(share * (1 << 32))), "validation").otherwise("train"))

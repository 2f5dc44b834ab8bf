"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of all it keeps; all but the last return the
columns of documents. The stages' rules for nulls, empty texts and repeated rows are those of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repairlake.llm import mixing, near_copies, packing, quality_rules, substring_dedup
from repairlake.llm.common import staged, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: close fingerprints, verified at a Jaccard similarity of 0.8 on 5-word shingles."""
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier ones hold."""
    return substring_dedup.remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their source's target asks."""
    return mixing.repeat_documents(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("mixing to target weights", mixture),
    ("best-fit packing", packs),
]

#: Similarity links and suffix automata are not SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

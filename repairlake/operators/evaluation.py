"""Summaries of evaluation results, and the texts that evaluation works with."""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of
from .scoring import first_by_id
from .traces import true


def pass_at_1(results: DataFrame, *by: str, dedupe: bool = True, order: tuple[str, ...] = ("shard", "seq")) -> DataFrame:
    """(by, total, passed, pass_at_1) of results (task_id, ok). dedupe: the first row of each task counts, within by."""
    rows = results.where(text_of(F.col("task_id").cast("string")) != "")
    if dedupe:
        keyed = rows.withColumn("_key", F.to_json(F.struct(*by, F.col("task_id").cast("string").alias("task_id")))) if by else rows.withColumn("_key", F.col("task_id").cast("string"))
        rows = first_by_id(keyed, *order, key="_key").drop("_key")
    won = F.count_if(true("ok"))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), won.alias("passed"), F.coalesce(F.try_divide(won, F.count("*")), F.lit(0.0)).alias("pass_at_1"))


def shard_losses(summaries: DataFrame) -> DataFrame:
    """(model, val_loss_avg, shards) of shard summaries (model, val_loss); a missing loss counts as 0."""
    return summaries.groupBy("model").agg(F.avg(F.coalesce("val_loss", F.lit(0.0))).alias("val_loss_avg"), F.count("*").alias("shards"))


def experiment_summary(records: DataFrame, selected: DataFrame, cards: DataFrame, corpus: DataFrame, samples: DataFrame) -> DataFrame:
    """One row of counts and the cards' average quality."""
    ids = records.where(text_of(F.col("id").cast("string")) != "").agg(F.countDistinct("id").alias("records_total_before_selection"))
    q = cards.agg(
        F.count("*").alias("repair_cards"), F.coalesce(F.avg("quality.overall"), F.lit(0.0)).alias("quality_avg"),
        F.count_if(true("quality.has_test_evidence")).alias("has_test_evidence"), F.count_if(true("quality.has_source_patch")).alias("has_source_patch"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  each side is one row
    return ids.crossJoin(one(selected, "selected_prs")).crossJoin(q).crossJoin(one(corpus, "corpus_records")).crossJoin(one(samples, "sft_records"))


def task_prompt(description, tests) -> Column:
    """A task with its first three tests."""
    return F.concat(
        F.lit("Write a complete Python solution for this task. Return only executable Python code, no explanation.\n\nTask:\n"), text_of(description),
        F.lit("\n\nTests:\n"), F.array_join(F.slice(tests, 1, 3), "\n"), F.lit("\n"),
    )


def code_of(completion: str) -> str:
    """The code of a model's answer: a fenced block marked python, else the first fenced block, else from the first
    definition (or all but comment lines) up to a stop mark."""
    pieces = completion.split("```")
    if len(pieces) > 1:
        marked = [p.lstrip()[6:] for p in pieces[1:] if p.lstrip().startswith("python")]
        return textwrap.dedent(marked[0] if marked else pieces[1]).strip()
    body = completion.replace("\r\n", "\n")
    at = re.search(r"(?m)^\s*(def|class)\s+\w+\s*[\(:]", body)
    body = body[at.start() :] if at else "\n".join(x for x in body.splitlines() if not x.lstrip().startswith("#"))
    for mark in ("\n# Task:", "\n# Tests:", "\nif __name__"):
        end = body.find(mark)
        body = body[:end] if end > 0 else body
    return textwrap.dedent(body).strip()


def extract_code(completion: Column) -> Column:
    @F.pandas_udf("string")
    def extract(completions):
        return completions.map(lambda c: None if c is None else code_of(c))

    return extract(completion)

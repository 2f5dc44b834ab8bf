"""Task manifests and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of
from .traces import true

DEFAULT_TEST_COMMAND = "python3 -m unittest discover -s tests"


def plan_manifest(rows: DataFrame, existing: DataFrame | None = None, limit: int | None = None, dry_run: bool = False, order: str = "seq") -> DataFrame:
    """rows (seq, repo, task, test_command) with action (run, skip) and reason. Rows without repo or task, and those
    whose repo is not among existing (repo), are skipped; after limit runs all that is left is skipped without
    a reason (emitted false, as no result row is written for those). With a limit, rows is read twice; order tells rows apart."""
    r = rows.withColumns({"test_command": F.coalesce(F.nullif("test_command", F.lit("")), F.lit(DEFAULT_TEST_COMMAND)) if "test_command" in rows.columns else F.lit(DEFAULT_TEST_COMMAND)})
    if existing is not None:
        r = r.join(existing.select(F.col("repo")).distinct().withColumn("_there", F.lit(True)), "repo", "left").withColumn("_there", true("_there"))
    else:
        r = r.withColumn("_there", F.lit(True))
    missing = (text_of("repo") == "") | (text_of("task") == "")
    runs = ~missing & ~F.lit(dry_run) & F.col("_there")
    r = r.withColumn("_runs", runs)
    if limit is None:
        r = r.withColumn("_full", F.lit(False))
    else:
        # what comes after the last of the first runs; only those reach one place, as many as the limit says
        first = r.where("_runs").orderBy(order).limit(limit).agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
        r = r.withColumn("_full", F.col(order) > first["last"] if limit and first["n"] == limit else F.lit(limit == 0))
    reason = F.when(F.col("_full"), None).when(missing, "missing repo or task").when(F.lit(dry_run), None).when(~F.col("_there"), "repo does not exist")
    act = F.when(F.col("_runs") & ~F.col("_full"), "run").otherwise("skip")
    return r.withColumns({"action": act, "reason": reason, "emitted": ~F.col("_full")}).drop("_runs", "_full", "_there")


def failure_attribution(source, outcome, checked, ok) -> Column:
    return (
        F.when(outcome == "success", "passed")
        .when(~F.coalesce(source == "unit_completion", F.lit(False)), "unknown")
        .when(F.coalesce(checked, F.lit(False)) & ~F.coalesce(ok, F.lit(False)), "baseline_failure")
        .when(outcome == "test_failed", "model_or_task_failure")
        .otherwise("unknown")
    )


def _results(results: DataFrame) -> DataFrame:
    skipped = true("skipped")
    return results.select(
        F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), skipped.alias("skipped"),
        F.when(skipped, "skipped").otherwise(F.coalesce(F.nullif("outcome", F.lit("")), F.lit("missing_outcome"))).alias("outcome"),
    )


def manifest_stats(results: DataFrame) -> DataFrame:
    """(source, total, ran, skipped, success, pass_rate) of results (source, skipped, outcome)."""
    won, ran = F.count_if((F.col("outcome") == "success") & ~F.col("skipped")), F.count_if(~F.col("skipped"))
    return _results(results).groupBy("source").agg(
        F.count("*").alias("total"), ran.alias("ran"), F.count_if("skipped").alias("skipped"), won.alias("success"),
        F.coalesce(F.round(F.try_divide(won, ran), 4), F.lit(0.0)).alias("pass_rate"),
    )


def manifest_outcomes(results: DataFrame) -> DataFrame:
    """(source, outcome, n)."""
    return _results(results).groupBy("source", "outcome").agg(F.count("*").alias("n"))

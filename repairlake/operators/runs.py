"""Runs of a task manifest: what manifests.plan_manifest says is run, one result row for each row it emits.

A manifest is a task list: its repositories' names reach the driver, which looks whether they exist. Files that are
no UTF-8 go to the workspace with their bad bytes replaced. The events of a run are part of its result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_of
from ..sources import jsonl
from ..sources.landing import landed
from . import agent, manifests
from .policy import IGNORED_FOLDERS

TASK = "struct<repo: string, task: string, test_command: string, source: string, baseline_checked: boolean, baseline_ok: boolean>"
SCHEME = "^[A-Za-z0-9+.-]+:/+"


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """(seq, raw: the row as variant, repo: resolved, task, ...) of the lines that are JSON objects, in order."""
    lines = jsonl.read_lines(spark, path, ordered=True).withColumn("raw", F.try_parse_json("value"))
    rows = lines.where(F.coalesce(F.schema_of_variant("raw"), F.lit("")).startswith("OBJECT"))
    rows = rows.withColumn("r", F.from_json("value", TASK)).withColumn("seq", F.row_number().over(Window.orderBy("path", "seq")).cast("long"))
    base = F.regexp_replace("path", "/[^/]*$", "")
    home = F.regexp_replace("r.repo", "^~(?=/|$)", os.path.expanduser("~"))
    repo = F.when(text_of("r.repo") == "", "").when(home.rlike(f"^/|{SCHEME}"), home).otherwise(F.concat_ws("/", base, home))
    return rows.select("seq", "raw", repo.alias("repo"), *[f"r.{c}" for c in ("task", "test_command", "source", "baseline_checked", "baseline_ok")])


def existing(spark: SparkSession, repos: list[str]) -> list[tuple[str, str]]:
    """(repo, its full path without scheme) of those that exist."""
    out = []
    for repo in repos:
        path = spark._jvm.org.apache.hadoop.fs.Path(repo)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            out.append((repo, fs.resolvePath(path).toString()))
    return out


def repo_files(spark: SparkSession, there: list[tuple[str, str]]) -> DataFrame:
    """(repo, files map<string,string>) of folders, without ignored ones."""
    plain = lambda c: F.regexp_replace(c, SCHEME, "/")
    repos = spark.createDataFrame(there, "repo string, root string").withColumn("root", F.concat(plain("root"), F.lit("/")))
    every = sorted({root for _, root in there})
    if not every:
        return repos.select("repo", F.lit(None).cast("map<string,string>").alias("files"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(every).select(plain("path").alias("full"), "content")
    inside = found.join(F.broadcast(repos), F.col("full").startswith(F.col("root")))
    files = inside.select("repo", F.expr("substring(full, length(root) + 1)").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))).dropDuplicates(["repo", "path"])
    return kept.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))


def run_manifest(spark: SparkSession, path: str, model: agent.Model, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """(source, result) of the rows of a manifest that are run or skipped with a result, in order. Runs are landed, so
    that reading the result again runs nothing again."""
    rows = landed(manifest_rows(spark, path), "manifest")
    there = existing(spark, [r.repo for r in rows.where("repo <> ''").select("repo").distinct().collect()])
    known = spark.createDataFrame(there, "repo string, root string")
    plan = landed(manifests.plan_manifest(rows, known, limit, dry_run).where("emitted"), "plan")
    tasks = plan.where("action = 'run'").join(repo_files(spark, there), "repo", "left")
    tasks = tasks.select(F.col("seq").alias("id"), F.coalesce("files", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("files"), "task", "test_command")
    # a short list would be one partition, and its runs one after another
    events = landed(agent.run_tasks(tasks.repartition(F.col("id")), model), "events")
    end = F.from_json("payload", "struct<outcome: string, summary: string>")
    done = events.groupBy(F.col("trace").cast("long").alias("seq")).agg(
        F.max(F.when(F.col("event") == "run_finished", F.struct("seq", end.alias("end"))))["end"].alias("end"),
        F.count_if(F.col("event") == "tool_call").alias("steps"),
        F.array_sort(F.collect_list(F.struct("seq", "ts", "event", "payload"))).alias("events"),
    )
    p = plan.join(done, "seq", "left").join(known.withColumnRenamed("root", "_root"), "repo", "left")
    ran, outcome = F.col("action") == "run", F.col("end.outcome")
    finished = ran & (outcome != "runner_error")
    result = F.struct(
        F.when(ran, outcome == "success").otherwise(F.lit(dry_run) & F.col("reason").isNull() & F.col("_root").isNotNull()).alias("ok"),
        (~ran).alias("skipped"), "reason",
        F.when(~ran & (F.col("repo") != "") & (F.coalesce("reason", F.lit("")) != "missing repo or task"), F.col("repo")).alias("repo_resolved"),
        outcome.alias("outcome"),
        F.when(finished, manifests.failure_attribution(F.col("source"), outcome, F.col("baseline_checked"), F.col("baseline_ok"))).alias("failure_attribution"),
        F.when(finished, F.col("steps")).alias("steps"), F.when(finished, F.col("end.summary")).alias("summary"),
        F.when(ran & ~finished, F.col("end.summary")).alias("error"), "events",
    )
    return p.orderBy("seq").select(F.col("raw").alias("source"), result.alias("result"))

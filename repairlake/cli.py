"""Commands over JSON-lines files: python -m repairlake COMMAND INPUT [OUTPUT] [--option value].

run takes a table of tasks (id, files, task, test_command), run-manifest a manifest (repo: a folder, from the
manifest's own if relative, task, test_command) of which it writes one {source, result} row each; both take the mock
model unless --base-url is given. The other commands are named after what they make.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.records import CLAIM, EVIDENCE, LLM_CARD, LLM_QUALITY, RECORD
from .operators import agent, cards, exports, manifests, runs, scoring, tasks, traces
from .sources import datasets, github, jsonl

CARD = (
    f"struct<id: string, repo: string, source_record: struct<pr_number: bigint, pr_url: string, issue_number: bigint>, files: array<string>, source_files: array<string>, test_files: array<string>,"
    f" evidence: {EVIDENCE}, repair_card: struct<symptom: {CLAIM}, localization: struct<source_files: array<string>, test_files: array<string>, evidence_ids: array<string>>, patch_intent: {CLAIM}, test_oracle: {CLAIM}, validation: {CLAIM}>,"
    " derived_tasks: struct<localize_files: struct<input: string, output: array<string>>, explain_bug: struct<input: string, output: string>, repair_instruction: struct<input: string, output: string>, test_spec: struct<input: string, output: string>>,"
    " quality: struct<has_issue: boolean, has_pr_text: boolean, has_source_patch: boolean, has_test_evidence: boolean, bug_fix_score: double, bug_fix_reasons: array<string>, evidence_coverage: double, grounding_score: double, patch_size_score: double, overall: double>,"
    f" llm_repair_card: {LLM_CARD}, llm_quality: {LLM_QUALITY}>"
)
RESULT = "struct<source: struct<source: string>, result: struct<skipped: boolean, outcome: string>>"
COMMANDS = (
    "run", "run-manifest", "export-sft", "export-repair-sft", "export-repair-corpus", "stats-repair-cards", "stats", "build-benchmark",
    "build-unit-completion", "build-mbpp", "build-humaneval", "build-pr-wiki", "build-repair-cards", "enrich-repair-cards", "fetch-github-prs",
)


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return jsonl.read_jsonl(spark, path, schema).select("record.*")


def make(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What a command makes, as a table."""
    model = agent.chat_model(a.base_url, a.model, os.environ.get("OPENAI_API_KEY", "")) if a.base_url else agent.mock_model
    record = "struct<" + ", ".join(f"{c}: {t}" for c, t in RECORD.items()) + ">"
    match a.command:
        case "run-manifest":
            return runs.run_manifest(spark, a.input, model, a.limit, a.dry_run)
        case "run":
            rows = _records(spark, a.input, "struct<id: string, files: map<string, string>, task: string, test_command: string>")
            return agent.run_tasks(rows if a.limit is None else rows.limit(a.limit), model)
        case "export-sft":
            return traces.sft_samples(jsonl.read_traces(spark, a.input), a.strict, a.clean_steps, a.reject_test_edits)
        case "export-repair-sft":
            return exports.repair_samples(_records(spark, a.input, CARD), exports.TASKS, a.variant, a.policy, a.min_quality, a.require_grounding)
        case "export-repair-corpus":
            return exports.corpus_records(_records(spark, a.input, CARD), a.min_quality, a.require_grounding, policy=a.policy)
        case "stats-repair-cards":
            return cards.card_stats(_records(spark, a.input, CARD))
        case "stats" if a.manifest:
            got = _records(spark, a.input, RESULT)
            return manifests.manifest_stats(got.select("source.source", "result.skipped", "result.outcome"))
        case "stats":
            return traces.run_stats(jsonl.read_traces(spark, a.input))
        case "build-benchmark" | "build-mbpp" | "build-humaneval":
            shape, seed, build = {"build-benchmark": (datasets.BENCHMARK, datasets.benchmark_seed, tasks.benchmark_tasks), "build-mbpp": (datasets.MBPP, datasets.mbpp_seed, tasks.mbpp_tasks), "build-humaneval": (datasets.HUMANEVAL, datasets.humaneval_seed, tasks.humaneval_tasks)}[a.command]
            rows = seed(spark) if a.input == "-" else jsonl.read_jsonl_strict(spark, a.input, shape)
            return build(rows, a.limit)
        case "build-unit-completion":
            files = jsonl.read_files(spark, a.input).withColumn("repo", F.lit(a.input))
            return tasks.completion_tasks(files, tasks.completion_targets(files), a.limit)
        case "build-pr-wiki":
            return cards.wiki(_records(spark, a.input, record))
        case "build-repair-cards":
            return cards.repair_cards(_records(spark, a.input, record), a.min_quality)
        case "enrich-repair-cards":
            return cards.enrich(_records(spark, a.input, CARD).where(F.col("quality.overall") >= a.min_quality), model, limit=a.limit)
        case "fetch-github-prs":
            spark.dataSource.register(github.PullRequests)
            found = spark.read.format("pull_requests").option("repo", a.input).option("limit", a.limit or 100).load()
            scored = scoring.with_quality(github.with_issues(found, github.PullRequests.get))
            return scoring.bug_fixes_only(scored) if a.bug_fix_only else scored
    raise ValueError(a.command)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="repairlake", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--limit", type=int)
    p.add_argument("--min-quality", type=float, default=0.0)
    p.add_argument("--variant", choices=exports.VARIANTS, default="full")
    p.add_argument("--policy", default="light")
    for flag in ("strict", "clean-steps", "reject-test-edits", "require-grounding", "manifest", "bug-fix-only", "dry-run"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--base-url")
    p.add_argument("--model", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("repairlake").getOrCreate()
    made = make(spark, a)
    if a.output:
        jsonl.write_jsonl(made, a.output)
    else:
        for row in made.select(F.to_json(F.struct(*made.columns)).alias("j")).toLocalIterator():
            print(row.j)
    return 0

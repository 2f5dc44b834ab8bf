"""Experiments: what a corpus is selected and made from, and how two models compare on held-out tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import landed
from . import evaluation, exports, selection
from .scoring import cached_union


def build(records: DataFrame, k: int, min_quality: float = 0.85, order: str = "seq") -> dict[str, DataFrame]:
    """The tables of an experiment from records of several caches (in their order): cards (the k best of the first
    record of each id, scored anew), selected_records by id, corpus, samples, and summary, one row of counts. Cards
    are landed, as the others are made from them."""
    cards = landed(selection.select_cards(cached_union(records, order), k, min_quality, order), "cards")
    selected = selection.selected_records(records, cards).orderBy(F.col("id").cast("string"), order)
    corpus = exports.corpus_records(cards, min_quality, max_evidence_chars=1200, policy="semantic")
    samples = exports.repair_samples(cards, variant="diff-only", policy="semantic")
    return {"cards": cards, "selected_records": selected, "corpus": corpus, "samples": samples, "summary": evaluation.experiment_summary(records, selected, cards, corpus, samples)}


def split(rows: DataFrame, ratio: float, key: str, seed: str = "split") -> DataFrame:
    """rows with split: validation for the first max(1, int(n * ratio)) in the order of a seeded digest of the key, else
    train. Rows are numbered in that order without one task holding them all."""
    most = max(1, int(rows.count() * ratio))
    placed = selection.numbered(rows.withColumn("_digest", F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))), "_digest", key, into="_place")
    return placed.withColumn("split", F.when(F.col("_place") < most, "validation").otherwise("train")).drop("_digest", "_place")


def to_evaluate(tasks: DataFrame, done: DataFrame, index: int, count: int, *order: str, key: str = "task_id") -> DataFrame:
    """The tasks of a shard, by place in the order, that have no result row yet."""
    return selection.not_completed(selection.shard(tasks, index, count, *order), done, key)


def ab_summary(losses: DataFrame, results: DataFrame, models: tuple[str, ...] = ("base", "repair_lora"), benches: tuple[str, ...] = ("humaneval", "mbpp")) -> DataFrame:
    """One row a model: val_loss_avg (null without shards) and shards of losses (model, val_loss); and for each bench total,
    passed and pass_at_1 of results (model, bench, shard, seq, task_id, ok), the first row of a task counting."""
    out = losses.sparkSession.createDataFrame([(m,) for m in models], "model string")
    out = out.join(evaluation.shard_losses(losses), "model", "left").withColumn("shards", F.coalesce("shards", F.lit(0).cast("long")))
    scored = evaluation.pass_at_1(results, "model", "bench")
    for b in benches:
        own = scored.where(F.col("bench") == b).select("model", *[F.col(c).alias(f"{b}_{c}") for c in ("total", "passed", "pass_at_1")])
        out = out.join(own, "model", "left").withColumns({f"{b}_{c}": F.coalesce(f"{b}_{c}", F.lit(0).cast(t)) for c, t in (("total", "long"), ("passed", "long"), ("pass_at_1", "double"))})
    return out


def build_summary(count: int, output: str, extra: str | None = None) -> str:
    """What a command has written, a line each."""
    return "\n".join([f"count={count}", f"output={output}", *([f"extra={extra}"] if extra else [])])


def card_stats_text(stats: DataFrame, derived: DataFrame | None = None, files: int = 1) -> str:
    """The row of cards.card_stats as lines of name=value, and the counts of derived tasks."""
    r = stats.first().asDict()
    share: Callable[[str, str], str] = lambda label, c: f"{label}={r[c]} ratio={r[c + '_ratio']}"
    lines = [f"files={files}", f"records={r['records']}", f"quality.overall=avg={r['quality_avg']} min={r['quality_min']} max={r['quality_max']}"]
    lines += [share(c, c) for c in ("has_test_evidence", "has_source_patch")] + [f"avg_bug_fix_score={r['avg_bug_fix_score']}"]
    lines += [share(c, c) for c in ("docs_only", "tests_only") if c in r]
    if "llm_valid_json" in r:
        lines += [share("llm.valid_json", "llm_valid_json"), share("llm.grounding_ok", "llm_grounding_ok"), f"llm.avg_field_coverage={r['llm_avg_field_coverage']}"]
    told = derived.orderBy("task").collect() if derived is not None else []  # a row for each kind of task
    return "\n".join(lines + (["derived_tasks=" + ", ".join(f"{t.task}:{t.n}" for t in told)] if told else []))


def run_check(code: str, timeout: float = 8) -> tuple[bool, str]:
    """Whether a program ends well, and the last 2000 characters of what it said."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "check.py")
        path.write_text(code, encoding="utf-8")
        try:
            ran = subprocess.run([sys.executable, str(path)], text=True, capture_output=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            return False, "timeout"
        return ran.returncode == 0, (ran.stdout + "\n" + ran.stderr).strip()[-2000:]


def checked(programs: DataFrame, timeout: float = 8) -> DataFrame:
    """programs (code, ...) with ok and error, each run by itself on an executor."""

    @F.pandas_udf("ok boolean, error string")
    def run(codes):
        import pandas as pd

        return pd.DataFrame([run_check(c or "", timeout) for c in codes], columns=["ok", "error"])

    return programs.withColumn("_check", run("code")).select(*programs.columns, "_check.ok", F.when(F.col("_check.ok"), "").otherwise(F.col("_check.error")).alias("error"))

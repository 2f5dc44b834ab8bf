"""Agent traces: (trace, seq, event, payload) in the order of seq.

The windows are all over trace, so that one shuffle serves the flags of a trace, the carried task and plan and
the bounded history. A payload is a struct of the fields below; missing ones are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diffs
from ..functions.text import text_of

PAYLOAD = (
    "struct<task: string, plan: string, sandbox_backend: string, step: int, tool: string, arguments: string, reason: string, raw_output: string,"
    " format_violation: boolean, retries_used: int, parse_error: string, elapsed_ms: double,"
    " result: struct<ok: boolean, output: string, blocked: boolean, error_type: string>, outcome: string, summary: string, diff: string>"
)
#: Fixed value: the instruction of every sample.
INSTRUCTION = "Given a coding task, plan, and previous tool history, choose the next safe tool call as JSON."
HISTORY, PROMPT_HISTORY = 6, 8


def true(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def clean_call() -> Column:
    """A tool call without violation, parse error, retry, block or error, whose result is ok."""
    p = "payload."
    return ~(
        true(p + "format_violation") | (text_of(p + "parse_error") != "") | (F.coalesce(p + "retries_used", F.lit(0)) != 0)
        | true(p + "result.blocked") | (text_of(p + "result.error_type") != "") | ~true(p + "result.ok")
    )


def edits_tests() -> Column:
    path = text_of(F.get_json_object("payload.arguments", "$.path"))
    return F.coalesce(F.col("payload.tool").isin("replace_in_file", "write_file"), F.lit(False)) & diffs.is_tests_path(path)


def trace_flags(events: DataFrame, reject_test_edits: bool = False) -> DataFrame:
    """(trace, successful, high_quality). The first run_finished decides on success."""
    call = F.col("event") == "tool_call"
    first = F.min_by(F.when(F.col("event") == "run_finished", F.col("payload")), F.when(F.col("event") == "run_finished", F.col("seq")))
    tested = F.coalesce(F.bool_or(call & (F.col("payload.tool") == "run_tests") & true("payload.result.ok")), F.lit(False))
    fine = clean_call() & ~edits_tests() if reject_test_edits else clean_call()
    got = events.groupBy("trace").agg(first.alias("f"), tested.alias("tested"), F.coalesce(F.bool_and(F.when(call, fine)), F.lit(True)).alias("clean"))
    won = F.coalesce(F.col("f.outcome") == "success", F.lit(False)) & F.col("tested")
    if reject_test_edits:
        won = won & ~F.coalesce(diffs.touches_tests(text_of("f.diff")), F.lit(False))
    return got.select("trace", won.alias("successful"), (won & F.col("clean")).alias("high_quality"))


def history_item() -> Column:
    p = "payload."
    return F.struct(F.col(p + "tool").alias("tool"), F.coalesce(p + "arguments", F.lit("{}")).alias("arguments"), F.col(p + "result.ok").alias("ok"), text_of(p + "result.error_type").alias("error_type"), true(p + "format_violation").alias("format_violation"))


def sft_samples(events: DataFrame, strict: bool = False, clean_steps: bool = False, reject_test_edits: bool = False, history: int = HISTORY) -> DataFrame:
    """(trace, seq, instruction, input, output, metadata): a sample for each call that did something, with the
    calls before it (all of them, whatever came of them) as history. strict keeps only traces of high quality,
    clean_steps only clean calls of successful traces."""
    if strict or clean_steps:
        flags = trace_flags(events, reject_test_edits)
        wanted = F.col("high_quality") if strict else F.col("successful")
        events = events.join(flags.where(wanted).select("trace"), "trace", "left_semi")
    w = Window.partitionBy("trace").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, field: text_of(F.last(F.when(F.col("event") == kind, text_of(f"payload.{field}")), ignorenulls=True).over(so_far))
    carried = events.withColumns({"_task": last("run_started", "task"), "_plan": last("plan", "plan")}).where(F.col("event") == "tool_call")
    seen = carried.withColumn("_history", F.collect_list(history_item()).over(w.rowsBetween(-history, -1)))
    tool = text_of("payload.tool")
    keep = (tool != "") & (tool != "finish") & true("payload.result.ok")
    if clean_steps:
        keep = keep & clean_call()
    return seen.where(keep).select(
        "trace",
        "seq",
        F.lit(INSTRUCTION).alias("instruction"),
        F.struct(F.col("_task").alias("task"), F.col("_plan").alias("plan"), F.col("_history").alias("history")).alias("input"),
        F.struct(F.col("payload.tool").alias("tool"), F.coalesce("payload.arguments", F.lit("{}")).alias("arguments"), text_of("payload.reason").alias("reason")).alias("output"),
        F.struct(F.col("trace"), F.col("payload.step").alias("step"), true("payload.format_violation").alias("format_violation")).alias("metadata"),
    )


def _runs(events: DataFrame) -> DataFrame:
    """One row a trace; the last run_started and run_finished count."""
    last = lambda kind, field: F.max_by(F.when(F.col("event") == kind, F.col(f"payload.{field}")), F.when(F.col("event") == kind, F.col("seq")))
    call = F.col("event") == "tool_call"
    return events.groupBy("trace").agg(
        last("run_finished", "outcome").alias("outcome"), last("run_started", "sandbox_backend").alias("backend"), last("run_finished", "elapsed_ms").alias("elapsed"),
        F.count_if(call).alias("steps"), F.count_if(call & true("payload.format_violation")).alias("violations"),
    )


def run_stats(events: DataFrame) -> DataFrame:
    """One row: runs, successes, pass rate, average steps and time, violations for each call."""
    won = F.count_if(F.col("outcome") == "success")
    rate = lambda a, b, n: F.coalesce(F.round(F.try_divide(a, b), n), F.lit(0.0))
    return _runs(events).agg(
        F.count("*").alias("total_runs"), won.alias("successes"), rate(won, F.count("*"), 4).alias("pass_rate"),
        F.coalesce(F.round(F.avg("steps"), 2), F.lit(0.0)).alias("avg_steps"), F.coalesce(F.round(F.avg("elapsed"), 2), F.lit(0.0)).alias("avg_elapsed_ms"),
        rate(F.sum("violations"), F.sum("steps"), 4).alias("format_violation_rate"),
    )


def run_outcomes(events: DataFrame) -> DataFrame:
    """(kind, name, n): runs by outcome and by backend."""
    runs = _runs(events)
    kinds = F.array(
        F.struct(F.lit("outcome").alias("kind"), F.coalesce(F.nullif("outcome", F.lit("")), F.lit("missing_outcome")).alias("name")),
        F.struct(F.lit("backend").alias("kind"), F.coalesce(F.nullif("backend", F.lit("")), F.lit("unknown")).alias("name")),
    )
    return runs.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))


def classify_outcomes(events: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(trace, outcome) from each trace's calls. Traces without one have no_actions."""
    call = F.col("event") == "tool_call"
    error = lambda e: F.coalesce(F.bool_or(call & (F.col("payload.result.error_type") == e)), F.lit(False))
    latest = lambda value, among: F.max_by(F.when(among, value), F.when(among, F.col("seq")))
    test = call & (F.col("payload.tool") == "run_tests")
    got = events.groupBy("trace").agg(
        F.count_if(call).alias("n"), error("invalid_json").alias("bad"), latest(true("payload.result.ok"), test).alias("tested"),
        F.coalesce(F.bool_or(call & true("payload.result.blocked")), F.lit(False)).alias("blocked"), error("edit_miss").alias("missed"),
        error("test_failed").alias("failed"), latest(F.col("payload.tool"), call).alias("last"),
    )
    full = F.col("n") >= max_steps if max_steps is not None else F.lit(False)
    outcome = (
        F.when(F.col("n") == 0, "no_actions").when(F.col("bad"), "invalid_json").when(F.coalesce("tested", F.lit(False)), "success").when(F.col("blocked"), "blocked_by_policy")
        .when(F.col("missed"), "edit_miss").when(F.col("failed"), "test_failed").when(full, "max_steps").when(F.col("last") == "finish", "finished_without_tests").otherwise("incomplete")
    )
    return got.select("trace", outcome.alias("outcome"))


def actor_prompts(events: DataFrame, test_command: str, tools: str, history: int = PROMPT_HISTORY) -> DataFrame:
    """(trace, seq, prompt): what an agent was shown before each call."""
    w = Window.partitionBy("trace").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, field: text_of(F.last(F.when(F.col("event") == kind, text_of(f"payload.{field}")), ignorenulls=True).over(so_far))
    carried = events.withColumns({"_task": last("run_started", "task"), "_plan": last("plan", "plan")}).where(F.col("event") == "tool_call")
    seen = carried.withColumn("_history", F.to_json(F.collect_list(history_item()).over(w.rowsBetween(-history, -1))))
    parts = ("Task:\n", F.col("_task"), "\n\nPlan:\n", F.col("_plan"), f"\n\nTest command:\n{test_command}\n\n{tools}\n\nRecent history:\n", F.col("_history"), "\n\nChoose the next single tool call. If complete, call finish.")
    return seen.select("trace", "seq", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("prompt"))

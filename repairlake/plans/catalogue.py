"""Registered queries over the driver's tables, and the same in SQL.

Analogues: a conversation is a trace (turn: seq, role: event); a user's events are a trace (event_type: what was
called, value: time taken); documents with labels are manifest results and cards; adjacent turns are an
issue and its pull request; a document's lines are a diff.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diffs, paths, text
from ..operators import cards, evaluation, experiments, exports, manifests, policy, scoring, selection, tasks, traces
from ..sources.landing import landed
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: a system turn starts a run, others are calls of a tool named after the role."""
    c = table(spark, sf_dir, "conversations")
    null = lambda t: F.lit(None).cast(t)
    is_call = F.col("role") != "system"
    payload = F.struct(
        F.when(~is_call, F.col("text")).alias("task"), null("string").alias("plan"), F.lit("local").alias("sandbox_backend"), F.col("turn").cast("int").alias("step"), F.when(is_call, F.col("role")).alias("tool"),
        F.lit("{}").alias("arguments"), F.lit("").alias("reason"), null("string").alias("raw_output"), F.lit(False).alias("format_violation"), F.lit(0).alias("retries_used"), F.lit("").alias("parse_error"), null("double").alias("elapsed_ms"),
        F.struct((F.length("text") % 3 != 0).alias("ok"), F.col("text").alias("output"), F.lit(False).alias("blocked"), F.lit("").alias("error_type")).alias("result"),
        null("string").alias("outcome"), null("string").alias("summary"), null("string").alias("diff"),
    )
    return c.select(F.col("conv_id").alias("trace"), F.col("turn").alias("seq"), F.when(is_call, "tool_call").otherwise("run_started").alias("event"), payload.alias("payload"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as traces: view is a test run, error fails, a signup finishes with the outcome success or failed."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    null = lambda t: F.lit(None).cast(t)
    kind = F.col("event_type")
    done = kind == "signup"
    bad = kind == "error"
    tool = F.when(kind == "view", "run_tests").when(kind == "purchase", "finish").otherwise(kind)
    payload = F.struct(
        null("string").alias("task"), null("string").alias("plan"), null("string").alias("sandbox_backend"), null("int").alias("step"), F.when(~done, tool).alias("tool"), F.col("props").alias("arguments"), F.lit("").alias("reason"),
        null("string").alias("raw_output"), (F.col("event_id") % 7 == 0).alias("format_violation"), F.lit(0).alias("retries_used"), F.lit("").alias("parse_error"), F.col("value").alias("elapsed_ms"),
        F.struct((~bad).alias("ok"), F.lit("").alias("output"), (F.col("event_id") % 11 == 0).alias("blocked"), F.when(bad, "test_failed").otherwise("").alias("error_type")).alias("result"),
        F.when(done, F.when(F.col("event_id") % 2 == 0, "success").otherwise("failed")).alias("outcome"), null("string").alias("summary"), null("string").alias("diff"),
    )
    return e.select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.when(done, "run_finished").otherwise("tool_call").alias("event"), payload.alias("payload"))


EVENTS_SQL = """
WITH e AS (SELECT user_id AS trace, event_id AS seq, event_type = 'signup' AS done, event_type = 'error' AS bad, value,
  CASE event_type WHEN 'view' THEN 'run_tests' WHEN 'purchase' THEN 'finish' ELSE event_type END AS tool,
  event_id % 7 = 0 AS violation, event_id % 11 = 0 AS blocked,
  CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failed' END AS outcome FROM events WHERE user_id IS NOT NULL),
flags AS (SELECT trace,
  coalesce(arg_min(outcome, seq) FILTER (done) = 'success', false) AND coalesce(bool_or(NOT done AND tool = 'run_tests' AND NOT bad), false) AS successful,
  coalesce(bool_and(NOT violation AND NOT blocked AND NOT bad) FILTER (NOT done), true) AS clean FROM e GROUP BY trace)
"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as manifest results: without a label skipped, toxic is failed."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.select("doc_id", "source", "lang", "n_chars").join(lab, "doc_id", "left")
    outcome = F.when(F.col("toxic") == 1, "test_failed").when(F.col("quality") == 1, "success").otherwise("")
    return j.select("doc_id", "source", "lang", "n_chars", F.col("quality").isNull().alias("skipped"), F.when(F.col("quality").isNotNull(), outcome).alias("outcome"), "quality", "toxic")


RESULTS_SQL = """
WITH r AS (SELECT doc_id, source, lang, n_chars, quality IS NULL AS skipped, quality, toxic,
  CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'test_failed' WHEN quality = 1 THEN 'success' ELSE '' END AS outcome
  FROM documents LEFT JOIN labels USING (doc_id))
"""


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diffs: odd lines added, even ones removed, under one header."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 2 == 0, "+").otherwise("-"), x))
    head = F.concat(F.lit("diff --git a/src/m"), F.col("doc_id").cast("string"), F.lit(".py b/src/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.select("doc_id", F.array_join(F.concat(F.array(head), lines), "\n").alias("diff"))


# --- traces ---


@query(
    """
SELECT conv_id AS trace, turn AS seq, role AS tool, history FROM (
  SELECT conv_id, turn, role, text, coalesce(string_agg(role, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history
  FROM conversations WHERE role <> 'system')
WHERE length(text) % 3 <> 0
"""
)
def sft_history_window(spark, sf_dir):
    s = traces.sft_samples(conversation_events(spark, sf_dir))
    return s.select("trace", "seq", F.col("output.tool").alias("tool"), F.array_join(F.transform("input.history", lambda h: h["tool"]), "|").alias("history"))


@query(
    EVENTS_SQL
    + """
SELECT trace, seq, tool, n_history::INTEGER AS n_history FROM (SELECT e.*, count(*) OVER (PARTITION BY trace ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n_history FROM e WHERE NOT done)
JOIN flags USING (trace) WHERE successful AND tool <> 'finish' AND NOT bad AND NOT violation AND NOT blocked
"""
)
def clean_step_samples(spark, sf_dir):
    s = traces.sft_samples(user_events(spark, sf_dir), clean_steps=True)
    return s.select("trace", "seq", F.col("output.tool").alias("tool"), F.size("input.history").alias("n_history"))


@query(EVENTS_SQL + "SELECT trace, successful, successful AND clean AS high_quality FROM flags")
def strict_trace_filter(spark, sf_dir):
    return traces.trace_flags(user_events(spark, sf_dir))


@query(
    EVENTS_SQL
    + """,
runs AS (SELECT trace, arg_max(outcome, seq) FILTER (done) AS outcome, arg_max(value, seq) FILTER (done) AS elapsed, count(*) FILTER (NOT done) AS steps, count(*) FILTER (NOT done AND violation) AS violations FROM e GROUP BY trace)
SELECT count(*) AS total_runs, count(*) FILTER (outcome = 'success') AS successes, round(count(*) FILTER (outcome = 'success') / count(*), 4) AS pass_rate, round(avg(steps), 2) AS avg_steps,
  round(avg(elapsed), 2) AS avg_elapsed_ms, round(sum(violations) / sum(steps), 4)::DOUBLE AS format_violation_rate FROM runs
"""
)
def run_stats(spark, sf_dir):
    return traces.run_stats(user_events(spark, sf_dir))


@query(
    EVENTS_SQL
    + """,
runs AS (SELECT trace, arg_max(outcome, seq) FILTER (done) AS outcome FROM e GROUP BY trace)
SELECT 'outcome' AS kind, coalesce(outcome, 'missing_outcome') AS name, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT 'backend', 'unknown', count(*) FROM runs
"""
)
def run_outcomes(spark, sf_dir):
    return traces.run_outcomes(user_events(spark, sf_dir))


@query(
    EVENTS_SQL
    + """
SELECT trace, CASE WHEN count(*) FILTER (NOT done) = 0 THEN 'no_actions' WHEN coalesce(arg_max(NOT bad, seq) FILTER (tool = 'run_tests' AND NOT done), false) THEN 'success'
  WHEN coalesce(bool_or(blocked AND NOT done), false) THEN 'blocked_by_policy' WHEN coalesce(bool_or(bad), false) THEN 'test_failed'
  WHEN arg_max(tool, seq) FILTER (NOT done) = 'finish' THEN 'finished_without_tests' ELSE 'incomplete' END AS outcome FROM e GROUP BY trace
"""
)
def classify_outcome(spark, sf_dir):
    return traces.classify_outcomes(user_events(spark, sf_dir))


@query(
    """
SELECT conv_id AS trace, turn AS seq, n::BIGINT AS n_history FROM (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS n FROM conversations WHERE role <> 'system')
"""
)
def actor_prompt_history(spark, sf_dir):
    p = traces.actor_prompts(conversation_events(spark, sf_dir), "pytest -q", "tools")
    shown = F.from_json(F.regexp_extract("prompt", r"(?s)Recent history:\n(.*)\n\nChoose", 1), "array<struct<tool: string>>")
    return p.select("trace", "seq", F.size(shown).cast("bigint").alias("n_history"))


# --- manifests and evaluation ---


@query(
    RESULTS_SQL
    + """
SELECT coalesce(source, 'unknown') AS source, count(*) AS total, count(*) FILTER (NOT skipped) AS ran, count(*) FILTER (skipped) AS skipped, count(*) FILTER (outcome = 'success') AS success,
  coalesce(round(count(*) FILTER (outcome = 'success') / nullif(count(*) FILTER (NOT skipped), 0), 4), 0) AS pass_rate FROM r GROUP BY 1
"""
)
def manifest_stats(spark, sf_dir):
    return manifests.manifest_stats(results(spark, sf_dir))


@query(RESULTS_SQL + "SELECT coalesce(source, 'unknown') AS source, CASE WHEN skipped THEN 'skipped' WHEN outcome = '' THEN 'missing_outcome' ELSE outcome END AS outcome, count(*) AS n FROM r GROUP BY 1, 2")
def manifest_outcomes(spark, sf_dir):
    return manifests.manifest_outcomes(results(spark, sf_dir))


@query(
    RESULTS_SQL
    + """
SELECT doc_id, CASE WHEN outcome = 'success' THEN 'passed' WHEN lang <> 'en' THEN 'unknown' WHEN n_chars % 2 = 0 AND quality IS DISTINCT FROM 1 THEN 'baseline_failure'
  WHEN outcome = 'test_failed' THEN 'model_or_task_failure' ELSE 'unknown' END AS attribution FROM r WHERE NOT skipped
"""
)
def failure_attribution(spark, sf_dir):
    r = results(spark, sf_dir).where("not skipped")
    source = F.when(F.col("lang") == "en", "unit_completion").otherwise("other")
    return r.select("doc_id", manifests.failure_attribution(source, F.col("outcome"), F.col("n_chars") % 2 == 0, F.col("quality") == 1).alias("attribution"))


@query(
    """
WITH m AS (SELECT doc_id, doc_id % 5 = 0 AS missing, n_chars % 3 = 0 AS there, coalesce(sum((doc_id % 5 <> 0 AND n_chars % 3 = 0)::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, CASE WHEN NOT missing AND there AND before < 100 THEN 'run' ELSE 'skip' END AS action,
  CASE WHEN before >= 100 THEN NULL WHEN missing THEN 'missing repo or task' WHEN NOT there THEN 'repo does not exist' END AS reason, before < 100 AS emitted FROM m
"""
)
def manifest_limit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("repo"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("t").alias("task"))
    there = d.where(F.col("n_chars") % 3 == 0).select(F.col("doc_id").cast("string").alias("repo"))
    return manifests.plan_manifest(rows, there, limit=100).select("doc_id", "action", "reason", "emitted")


@query("SELECT quality AS model, count(DISTINCT doc_id) AS total, count(DISTINCT doc_id) FILTER (toxic = 0) AS passed, count(DISTINCT doc_id) FILTER (toxic = 0) / count(DISTINCT doc_id) AS pass_at_1 FROM labels GROUP BY quality")
def pass_at_1(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("quality").alias("model"), F.col("doc_id").alias("task_id"), (F.col("toxic") == 0).alias("ok"), F.lit(0).alias("shard"), F.col("doc_id").alias("seq"))
    return evaluation.pass_at_1(lab, "model")


@query("SELECT event_type AS model, round(avg(coalesce(value, 0)), 6) AS val_loss_avg, count(*) AS shards FROM events GROUP BY 1")
def shard_losses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("val_loss"))
    return evaluation.shard_losses(e).withColumn("val_loss_avg", F.round("val_loss_avg", 6))


@query(
    """
WITH m(model) AS (VALUES ('en'), ('de'), ('none')), j AS (SELECT lang AS model, CASE WHEN d.doc_id % 2 = 0 THEN 'humaneval' ELSE 'mbpp' END AS bench, (d.doc_id // 4) AS task_id, d.doc_id % 4 // 2 AS shard, quality = 1 AS ok FROM documents d JOIN labels USING (doc_id)),
f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY model, bench, task_id ORDER BY shard) = 1),
l AS (SELECT lang AS model, round(avg(n_chars), 6) AS val_loss_avg, count(*) AS shards FROM documents GROUP BY 1)
SELECT model, max(val_loss_avg) AS val_loss_avg, coalesce(max(shards), 0) AS shards, count(task_id) FILTER (bench = 'humaneval') AS humaneval_total, count(*) FILTER (bench = 'humaneval' AND ok) AS humaneval_passed,
  coalesce(count(*) FILTER (bench = 'humaneval' AND ok) / nullif(count(*) FILTER (bench = 'humaneval'), 0), 0) AS humaneval_pass_at_1, count(task_id) FILTER (bench = 'mbpp') AS mbpp_total, count(*) FILTER (bench = 'mbpp' AND ok) AS mbpp_passed,
  coalesce(count(*) FILTER (bench = 'mbpp' AND ok) / nullif(count(*) FILTER (bench = 'mbpp'), 0), 0) AS mbpp_pass_at_1
FROM m LEFT JOIN l USING (model) LEFT JOIN f USING (model) GROUP BY model
"""
)
def ab_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), "n_chars")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    results = rows.select("model", F.when(F.col("doc_id") % 2 == 0, "humaneval").otherwise("mbpp").alias("bench"), F.expr("doc_id div 4").alias("task_id"), F.expr("doc_id % 4 div 2").alias("shard"), F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("ok"))
    return experiments.ab_summary(d.select("model", F.col("n_chars").cast("double").alias("val_loss")), results, ("en", "de", "none")).withColumn("val_loss_avg", F.round("val_loss_avg", 6))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('split:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'validation' ELSE 'train' END AS split FROM documents")
def exact_split(spark, sf_dir):
    return experiments.split(table(spark, sf_dir, "documents").select("doc_id"), 0.1, "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE i % 2 = 0")
def to_evaluate(spark, sf_dir):
    return experiments.to_evaluate(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), 0, 2, "doc_id", key="doc_id")


@query()
def experiment(spark, sf_dir):
    both = shaped_records(spark, sf_dir).withColumn("repo", F.lit("acme/tool"))
    made = experiments.build(landed(both.withColumn("seq", F.col("id")), "records"), 50, 0.5)
    return made["summary"]


# --- selection ---

CARD_SQL = RESULTS_SQL + """, c AS (SELECT doc_id, source, n_chars, (CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 3 ELSE 1 END)::DOUBLE AS score, (n_chars % 5)::INT AS n_source, (n_chars % 14)::INT AS n_test,
  (CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END + 1 + CASE WHEN n_chars % 5 > 0 THEN 1 ELSE 0 END + CASE WHEN n_chars % 14 > 0 THEN 1 ELSE 0 END) / 4 AS coverage FROM r),
q AS (SELECT *, CASE WHEN n_source + n_test = 0 THEN 0 WHEN n_source + n_test <= 6 THEN 1 WHEN n_source + n_test <= 12 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END::DOUBLE AS size_score FROM c),
o AS (SELECT *, round(coverage * 0.35::DOUBLE + coverage * 0.25::DOUBLE + size_score * 0.2::DOUBLE + greatest(0, least(1, score / 5)) * 0.2::DOUBLE, 3) AS overall FROM q)
"""


def card_like(spark, sf_dir):
    r = results(spark, sf_dir)
    c = r.select("doc_id", "source", F.when(F.col("quality").isNull(), 0.0).when(F.col("quality") == 1, 3.0).otherwise(1.0).alias("score"), (F.col("n_chars") % 5).cast("int").alias("n_source"), (F.col("n_chars") % 14).cast("int").alias("n_test"), F.col("quality").isNotNull().alias("labelled"))
    one = lambda x: F.when(x, 1).otherwise(0)
    coverage = (one(F.col("labelled")) + 1 + one(F.col("n_source") > 0) + one(F.col("n_test") > 0)) / 4
    c = c.withColumns({"coverage": coverage, "size_score": cards.patch_size_score(F.col("n_source") + F.col("n_test"))})
    return c.withColumn("overall", cards.overall_quality(F.col("coverage"), F.col("coverage"), F.col("size_score"), F.col("score")))


@query(CARD_SQL + "SELECT doc_id, coverage::DOUBLE AS coverage, size_score, overall FROM o")
def quality_score(spark, sf_dir):
    return card_like(spark, sf_dir).select("doc_id", "coverage", "size_score", "overall")


@query(
    CARD_SQL
    + """
SELECT count(*) AS records, round(avg(overall), 3) AS quality_avg, min(overall) AS quality_min, max(overall) AS quality_max, count(*) FILTER (n_test > 0) AS has_test_evidence, round(count(*) FILTER (n_test > 0) / count(*), 3) AS has_test_evidence_ratio,
  count(*) FILTER (n_source > 0) AS has_source_patch, round(count(*) FILTER (n_source > 0) / count(*), 3) AS has_source_patch_ratio, round(avg(score), 3) AS avg_bug_fix_score FROM o
"""
)
def card_quality_stats(spark, sf_dir):
    c = card_like(spark, sf_dir)
    q = F.struct("overall", (F.col("n_test") > 0).alias("has_test_evidence"), (F.col("n_source") > 0).alias("has_source_patch"), F.col("score").alias("bug_fix_score"))
    return cards.card_stats(c.select(q.alias("quality")))


@query(CARD_SQL + "SELECT doc_id, overall, score, n_test FROM o ORDER BY overall DESC, score DESC, n_test DESC, doc_id LIMIT 100")
def top_cards(spark, sf_dir):
    c = card_like(spark, sf_dir)
    shaped = c.select("doc_id", "n_test", F.struct("overall", F.col("score").alias("bug_fix_score")).alias("quality"), F.array_repeat(F.lit("t"), F.col("n_test")).alias("test_files"))
    return selection.top_cards(shaped, 100, "doc_id").select("doc_id", "quality.overall", F.col("quality.bug_fix_score").alias("score"), "n_test")


@query("SELECT min(doc_id) AS doc_id, text AS id FROM documents WHERE coalesce(text, '') <> '' GROUP BY text")
def first_wins_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("id"))
    return scoring.first_by_id(d, "doc_id")


@query(
    """
SELECT id, file, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, doc_id) AS nth FROM (
  SELECT source || '_' || n_chars AS id, 0 AS file, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT source || '_' || n_chars, 1, doc_id FROM documents)) WHERE nth = 1 AND id IS NOT NULL
"""
)
def cached_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("id", F.concat_ws("_", "source", "n_chars"))
    one = lambda df, i: df.select("id", F.lit(i).alias("file"), "doc_id")
    return scoring.first_by_id(one(d.where("lang = 'en'"), 0).unionByName(one(d, 1)), "file", "doc_id")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def semi_selected(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return selection.selected_records(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select(F.col("id").alias("doc_id"), "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def anti_completed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.not_completed(d, table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 3 = 1")
def shard_mod(spark, sf_dir):
    return selection.shard(table(spark, sf_dir, "documents").select("doc_id"), 1, 3, "doc_id")


@query("SELECT doc_id, CASE WHEN ('0x' || left(md5('split:' || doc_id), 8))::BIGINT < 858993459 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return selection.hash_split(table(spark, sf_dir, "documents").select("doc_id"), 0.2, key="doc_id")


# --- text ---

SQL_WS = "'[" + text.WS[1:-1] + "]+'"
FREQUENT = ("the", "and", "ci", "un", "die", "of the", "de la")


def _sql_hit(column: str, word: str) -> str:
    inner = word.replace(" ", text.WS + "+")
    return rf"regexp_matches(lower({column}), '(^|[^\pL\pN_]){inner}($|[^\pL\pN_])')"


@query("SELECT doc_id, " + " || '|' || ".join(f"CASE WHEN {_sql_hit('text', w)} THEN '{w}' ELSE '' END" for w in FREQUENT) + " AS hits FROM documents")
def keyword_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = text.keyword_hits(text.text_of("text"), FREQUENT)
    return d.select("doc_id", F.array_join(F.array(*[F.when(F.array_contains(hits, w), w).otherwise("") for w in FREQUENT]), "|").alias("hits"))


@query(
    "SELECT doc_id, ("
    + " + ".join(f"{_sql_hit('text', w)}::INT" for w in ("the", "and", "of"))
    + ") >= 2 AND (NOT "
    + _sql_hit("text", "ci")
    + " OR "
    + _sql_hit("text", "the")
    + ") AS kept FROM documents"
)
def text_prefilter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scoring.text_prefilter("text", F.lit(""), 2, ("the", "and", "of"), ("ci",), ("the",)).alias("kept"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


@query(
    f"""
WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x))), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, CASE WHEN least(len(w), len(before)) > 0 THEN round(len(list_intersect(w, before)) / least(len(w), len(before)), 3) ELSE 0 END AS share FROM p WHERE before IS NOT NULL
"""
)
def token_overlap(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.meaningful_tokens(text.text_of("text")).alias("w"))
    p = c.withColumn("before", F.lag("w").over(w)).where("before is not null")
    return p.select("conv_id", "turn", scoring.overlap_share(F.col("w"), F.col("before")).alias("share"))


@query(f"SELECT doc_id, trim(regexp_replace(text, {SQL_WS}, ' ', 'g')) AS text FROM documents")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compact("text").alias("text"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'item') AS id FROM pages")
def safe_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_id("url").alias("id"))


REDACT_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, 'sk-[A-Za-z0-9_-]{{12,}}', '[REDACTED]', 'g'), '(?:ghp|github_pat|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{{12,}}', '[REDACTED]', 'g'), 'Bearer\\s+[A-Za-z0-9._-]{{16,}}', '[REDACTED]', 'g')"


@query("SELECT id, " + REDACT_SQL.format("title || ' ' || body") + " AS text FROM " + fx.sql_values(fx.TEXTS, "id, title, body") + " UNION ALL SELECT doc_id + 1000, " + REDACT_SQL.format("text") + " FROM documents")
def redact(spark, sf_dir):
    some = fx.relation(spark, fx.TEXTS, fx.TEXTS_SCHEMA).select("id", text.redact(F.concat("title", F.lit(" "), "body")).alias("text"))
    return some.unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), text.redact(F.col("text")).alias("text")))


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS html FROM pages")
def strip_html_comments(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.without_html_comments(F.col("html")).alias("html"))


def _cleaned(policy_name: str):
    def run(spark, sf_dir):
        pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.clean_text(text.text_of("html"), policy_name).alias("text"))
        some = fx.relation(spark, fx.TEXTS, fx.TEXTS_SCHEMA).select((-F.col("id")).alias("id"), text.clean_text(F.col("body"), policy_name).alias("text"))
        return pages.unionByName(some)

    return run


for _p in ("light", "strict", "semantic"):  # lookahead, which DuckDB's patterns lack
    QUERIES[f"clean_{_p}"] = _cleaned(_p)

NOISE_SQL = r"regexp_replace(regexp_replace(regexp_replace(title || chr(10) || body, '(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g')"
VERBS_SQL = r"(?i)(?:^|[^\pL\pN_])(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\s*:?\s+"


@query(
    f"WITH t AS (SELECT id, {NOISE_SQL} AS t FROM "
    + fx.sql_values(fx.TEXTS, "id, title, body")
    + rf") SELECT id::BIGINT AS id, coalesce(nullif(regexp_extract(t, '{VERBS_SQL}(?:[\w.-]+/[\w.-]+)?#([0-9]+)($|[^\pL\pN_])', 1), ''), nullif(regexp_extract(t, '{VERBS_SQL}https://github\.com/[^/\s]+/[^/\s]+/issues/([0-9]+)($|[^\pL\pN_])', 1), ''))::INTEGER AS issue FROM t"
)
def linked_issue(spark, sf_dir):
    return fx.relation(spark, fx.TEXTS, fx.TEXTS_SCHEMA).select("id", text.linked_issue("title", "body").alias("issue"))


@query(
    "SELECT id::BIGINT AS id, CASE WHEN json_valid(answer) AND json_type(answer) = 'OBJECT' THEN true WHEN json_valid(regexp_extract(answer, '(?s)\\{.*\\}')) THEN true ELSE false END AS found FROM "
    + fx.sql_values(fx.ANSWERS, "id, answer")
    + " UNION ALL SELECT event_id + 100, json_valid(props) FROM events"
)
def extract_json(spark, sf_dir):
    some = fx.relation(spark, fx.ANSWERS, fx.ANSWERS_SCHEMA).select("id", text.json_object(F.col("answer")).isNotNull().alias("found"))
    return some.unionByName(table(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("id"), text.json_object(text.text_of("props")).isNotNull().alias("found")))


# --- paths, policy, files ---

PATH_SQL = r"""
WITH p AS (SELECT path, lower(path) AS l, regexp_extract(lower(path), '[^/]*$') AS n FROM {0}),
k AS (SELECT path, regexp_matches(l, '^tests?/|/tests?/') OR starts_with(n, 'test_') OR regexp_matches(n, '(_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts)$') AS is_test,
  regexp_matches(l, '^(docs|doc|\.github|github)/') OR n IN ('readme', 'changelog', 'changes', 'license', 'license.md') OR regexp_matches(n, '^(readme|changelog|changes)\.') OR regexp_matches(l, '\.(md|rst|txt|adoc)$') OR (regexp_matches(l, '\.ya?ml$') AND regexp_matches(l, 'workflow|ci')) AS is_docs,
  n IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'pdm.lock', 'requirements.txt', 'go.sum', 'cargo.lock', 'gemfile.lock') AS named,
  regexp_matches(l, '\.(lock|sum)$') AS locked, regexp_matches(l, '(\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|go\.sum|\.min\.js|\.min\.css)$') OR regexp_matches('/' || l, '/(vendor|dist|build|generated|node_modules|migrations)/') AS quiet FROM p)
SELECT path, is_test, is_docs, named OR locked AS is_dependency, named OR quiet AS is_low_signal, path <> '' AND NOT is_test AND NOT is_docs AND NOT (named OR quiet) AS is_source FROM k
"""


def _classified(df: DataFrame) -> DataFrame:
    p = F.col("path")
    return df.select("path", paths.is_test(p).alias("is_test"), paths.is_docs_or_config(p).alias("is_docs"), paths.is_dependency(p).alias("is_dependency"), paths.is_low_signal(p).alias("is_low_signal"), paths.is_source(p).alias("is_source"))


@query(PATH_SQL.format("(SELECT path FROM " + fx.sql_values(fx.PATHS, "path") + " UNION ALL SELECT url FROM pages)"))
def path_classify(spark, sf_dir):
    some = fx.relation(spark, [(p,) for p in fx.PATHS], "path string")
    return _classified(some.unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path"))))


@query(
    "WITH c AS (SELECT command, CASE WHEN trim(command) = '' THEN 'pytest -q' ELSE trim(regexp_replace(command, '\\s+', ' ', 'g')) END AS n FROM "
    + fx.sql_values(fx.COMMANDS, "command")
    + ") SELECT command, CASE WHEN "
    + " OR ".join(f"contains(lower(n), '{p}')" for p in policy.DANGEROUS)
    + " THEN 'dangerous' WHEN "
    + " OR ".join(f"starts_with(n, '{p}')" for p in policy.ALLOWED)
    + " THEN 'allowed' ELSE 'not_allowlisted' END AS verdict FROM c"
)
def command_policy(spark, sf_dir):
    return fx.relation(spark, [(c,) for c in fx.COMMANDS], "command string").select("command", policy.command_verdict("command").alias("verdict"))


@query("SELECT * FROM " + fx.sql_values(fx.WRITE_VERDICTS, "path, verdict"))
def write_policy(spark, sf_dir):
    return fx.relation(spark, [(p,) for p, _ in fx.WRITE_VERDICTS], "path string").select("path", policy.write_verdict("path").alias("verdict"))


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT lpad(doc_id::VARCHAR, 9, '0') AS path, line_no::INTEGER AS line_no, line FROM l WHERE regexp_matches(line, '(?i)\bthe .*tion') ORDER BY 1, 2 LIMIT 80
"""
)
def grep_lines(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").alias("content"))
    return policy.grep_lines(files, r"(?i)\bthe .*tion")


# --- diffs ---

LINES_SQL = """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END || x AS line FROM d),
c AS (SELECT doc_id, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed FROM m GROUP BY doc_id)
"""


@query("SELECT doc_id, 'src/m' || doc_id || '.py' AS file FROM documents")
def diff_files(spark, sf_dir):
    return document_diffs(spark, sf_dir).select("doc_id", F.explode(diffs.files_of(F.col("diff"))).alias("file"))


@query(LINES_SQL + "SELECT doc_id, added::INTEGER AS added, removed::INTEGER AS removed FROM c")
def diff_counts(spark, sf_dir):
    return document_diffs(spark, sf_dir).select("doc_id", diffs.line_counts(F.col("diff")).alias("c")).select("doc_id", "c.*")


@query(LINES_SQL + "SELECT doc_id, 'Patch touches src/m' || doc_id || '.py; added lines=' || added || ', removed lines=' || removed || '.' AS summary FROM c")
def diff_summary(spark, sf_dir):
    return document_diffs(spark, sf_dir).select("doc_id", diffs.summarize_diff(F.col("diff")).alias("summary"))


@query(
    LINES_SQL
    + r""",
a AS (SELECT doc_id, -1 AS i, 'diff --git a/src/m' || doc_id || '.py b/src/m' || doc_id || '.py' AS line FROM documents UNION ALL SELECT * FROM m),
b AS (SELECT *, trim(regexp_replace(line, '^[+-]', '')) AS bare FROM a),
k AS (SELECT *, CASE WHEN i = -1 OR regexp_matches(line, '^(--- |\+\+\+ )') THEN 'H' WHEN bare = '' OR length(bare) > 500 OR (regexp_full_match(bare, '[{}\[\],:0-9A-Fa-fx_."'' -]+') AND length(bare) > 120) THEN 'L' ELSE 'K' END AS kind FROM b),
r AS (SELECT *, sum((kind <> 'L')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run, count(*) OVER (PARTITION BY doc_id) AS n FROM k),
e AS (SELECT doc_id, min(i) FILTER (kind = 'K' AND run >= 90) AS stop FROM r GROUP BY doc_id),
s AS (SELECT doc_id, max(n) AS n, max(stop) AS stop, count(*) FILTER (kind <> 'L') AS kept, count(*) FILTER (kind = 'L') AS low FROM r JOIN e USING (doc_id) WHERE stop IS NULL OR i <= stop GROUP BY doc_id)
SELECT doc_id, kept::INTEGER AS kept, (low + CASE WHEN stop IS NULL THEN 0 ELSE greatest(0, n - kept) END)::INTEGER AS omitted FROM s
"""
)
def diff_clean(spark, sf_dir):
    p = document_diffs(spark, sf_dir).withColumn("p", F.explode(diffs.file_patches(F.col("diff"))))
    got = p.select("doc_id", F.split(diffs.clean_patch(F.col("p.path"), F.col("p.lines")), "\n").alias("x"))
    last = F.regexp_extract(F.element_at("x", -1), r"^\.\.\. omitted ([0-9]+) low-signal", 1)
    return got.select("doc_id", (F.size("x") - F.when(last != "", 1).otherwise(0)).alias("kept"), F.coalesce(F.nullif(last, F.lit("")).cast("int"), F.lit(0)).alias("omitted"))


# --- records, cards, exports ---


def turn_records(spark, sf_dir):
    """A user's turn and the next assistant's as issue and pull request, with a diff of the document of that number."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_text": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    return c.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.lit("acme/tool").alias("repo"), F.col("turn").alias("pr_number"), F.lit("fix").alias("pr_title"), F.col("next_text").alias("pr_body"),
        (F.col("conv_id") + 1).alias("issue_number"), F.lit("").alias("issue_title"), F.col("text").alias("issue_body"),
        F.concat(F.lit("diff --git a/src/m.py b/src/m.py\n+x\n-y\ndiff --git a/tests/test_m.py b/tests/test_m.py\n+"), F.regexp_replace("text", "\n", " ")).alias("diff"),
    )


TURNS_SQL = """
WITH t AS (SELECT conv_id, turn, text, role, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id || '_' || turn AS id, text, next_text FROM t WHERE role = 'user' AND next_role = 'assistant')
"""


#: By shape of a record: its files, as SQL. The last shape is very large.
SHAPES = (["src/m.py", "tests/test_m.py"], ["docs/guide.md"], ["tests/test_m.py"], ["poetry.lock"], ["web/dist/app.min.js", "vendor/lib.c"], ["src/m.py"], [f"src/f{i}.py" for i in range(31)])
#: What pull requests say besides their turn's text, by turn.
SAID = ("", "a regression that fails with an error", "typo in the changelog", "wrong result, TypeError", "")


def shaped_records(spark, sf_dir):
    """Adjacent user and assistant turns as records of every kind: source with tests, documentation, tests or locks alone,
    generated files, very large; linked to an issue or not."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_text": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    files = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in SHAPES]), (F.col("conv_id") % len(SHAPES) + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("turn") % len(SAID) + 1).cast("int"))
    linked = F.col("conv_id") % 3 != 0
    patches = F.array_join(F.transform(files, lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n+x = 1\n-y = 2"))), "\n")
    return c.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 2 == 1, "Fix it").otherwise("Update").alias("pr_title"), F.concat("next_text", F.lit(" "), said).alias("pr_body"),
        F.when(linked, F.col("conv_id") + 1).alias("issue_number"), F.lit("").alias("issue_title"), F.when(linked, F.col("text")).otherwise("").alias("issue_body"),
        F.concat(patches, F.lit("\n+"), F.regexp_replace("text", "\n", " ")).alias("diff"),
    )


def _sql_hits(column: str, words) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_sql_hit(column, w.lower())} THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def _sql_tokens(column: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({column}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x))), lambda x: NOT list_contains({STOP_SQL}, x))"


def _sql_reason(label: str, hits: str) -> str:
    return f"CASE WHEN len({hits}) > 0 THEN '{label}: ' || array_to_string({hits}[1:5], ', ') END"


SCORE_SQL = f"""
WITH t AS (SELECT conv_id, turn, text, role, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id || '_' || turn AS id, conv_id % {len(SHAPES)} AS shape, conv_id % 3 <> 0 AS linked, CASE WHEN turn % 2 = 1 THEN 'Fix it' ELSE 'Update' END AS title,
  next_text || ' ' || [{", ".join(f"'{x}'" for x in SAID)}][turn % {len(SAID)} + 1] AS body, CASE WHEN conv_id % 3 <> 0 THEN text ELSE '' END AS issue, '+x = 1' || chr(10) || '-y = 2' || chr(10) || '+' || replace(text, chr(10), ' ') AS changed
  FROM t WHERE role = 'user' AND next_role = 'assistant'),
h AS (SELECT *, {_sql_hits("(title || chr(10) || body || chr(10) || chr(10) || issue)", text.POSITIVE_KEYWORDS)} AS up, {_sql_hits("changed", text.POSITIVE_KEYWORDS)} AS up_diff,
  {_sql_hits("(title || chr(10) || body || chr(10) || chr(10) || issue)", text.NEGATIVE_KEYWORDS)} AS down, {_sql_tokens("issue")} AS it,
  {_sql_tokens("regexp_replace(regexp_replace(regexp_replace(title || ' ' || body, '(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g')")} AS pt,
  shape IN (0, 5, 6) AS src, shape IN (0, 2) AS tst, shape = 1 AS docs, shape = 2 AS tests, shape = 3 AS dep, shape IN (1, 3, 4) AS low, shape = 6 AS huge FROM u),
s AS (SELECT *, CASE WHEN trim(issue) <> '' AND least(len(it), len(pt)) > 0 THEN round(len(list_intersect(it, pt)) / least(len(it), len(pt)), 3) ELSE 0 END AS same, linked AND issue <> '' AS told FROM h),
p AS (SELECT *, least(3, len(up)) + CASE WHEN len(up_diff) > 0 THEN 1 ELSE 0 END + linked::INT + CASE WHEN told AND same >= 0.12 THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN told AND same < 0.04 THEN 1.5::DOUBLE ELSE 0 END
  + src::INT + CASE WHEN src AND tst THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN len(down) > 0 THEN 3 ELSE 0 END - 4 * docs::INT - 3 * tests::INT - 4 * dep::INT - 3 * low::INT - 2 * huge::INT AS score FROM s)
SELECT id, score::DOUBLE AS bug_fix_score, score >= 2 AND NOT docs AND NOT tests AND NOT dep AND NOT low AS is_bug_fix, same::DOUBLE AS issue_pr_consistency, docs AS docs_only, tests AS tests_only, dep AS dependency_only,
  low AS low_signal_only, huge AS large_patch, concat_ws('; ', {_sql_reason("positive text keywords", "up")}, {_sql_reason("positive diff keywords", "up_diff")}, CASE WHEN linked THEN 'linked issue' END,
  CASE WHEN told AND same >= 0.12 THEN 'issue and PR text are consistent' END, CASE WHEN told AND same < 0.04 THEN 'issue and PR text are weakly aligned' END, CASE WHEN src THEN 'touches source files' END,
  CASE WHEN src AND tst THEN 'touches tests with source' END, {_sql_reason("negative keywords", "down")}, CASE WHEN docs THEN 'docs or CI/config only' END, CASE WHEN tests THEN 'tests only' END,
  CASE WHEN dep THEN 'dependency files only' END, CASE WHEN low THEN 'low-signal generated/vendor/config files only' END, CASE WHEN huge THEN 'very large patch' END) AS reasons FROM p
"""


@query(SCORE_SQL)
def bug_fix_score(spark, sf_dir):
    s = scoring.with_quality(shaped_records(spark, sf_dir))
    flags = ("docs_only", "tests_only", "dependency_only", "low_signal_only", "large_patch")
    return s.select("id", "bug_fix_score", "is_bug_fix", "issue_pr_consistency", *flags, F.array_join("bug_fix_reasons", "; ").alias("reasons"))


@query(
    TURNS_SQL
    + f""", x AS (SELECT id, trim(regexp_replace(text, {SQL_WS}, ' ', 'g')) AS issue, trim(regexp_replace('fix' || chr(10) || next_text, {SQL_WS}, ' ', 'g')) AS pr FROM u)
SELECT id, CASE WHEN issue = '' THEN 3 ELSE 4 END::INTEGER AS n_evidence, CASE WHEN issue = '' THEN 'E1:pr_text' ELSE 'E1:issue_text' END AS first_evidence, left(CASE WHEN issue = '' THEN pr ELSE issue END, 1600) AS first_text FROM x
"""
)
def evidence_numbering(spark, sf_dir):
    c = cards.repair_cards(turn_records(spark, sf_dir))
    first = F.get("evidence", F.lit(0))
    return c.select("id", F.size("evidence").alias("n_evidence"), F.concat(first["id"], F.lit(":"), first["type"]).alias("first_evidence"), first["text"].alias("first_text"))


@query(
    TURNS_SQL
    + f""", x AS (SELECT id, trim(regexp_replace(text, {SQL_WS}, ' ', 'g')) AS issue FROM u)
SELECT id, 'src/m.py' AS source_files, 'tests/test_m.py' AS test_files, 'fix' || CASE WHEN issue = '' THEN '' ELSE ': ' || left(issue, 300) END AS symptom, 'src/m.py: added lines=1, removed lines=1' AS patch FROM x
"""
)
def repair_cards(spark, sf_dir):
    c = cards.repair_cards(turn_records(spark, sf_dir))
    return c.select("id", F.array_join("source_files", ",").alias("source_files"), F.array_join("test_files", ",").alias("test_files"), F.col("repair_card.symptom.text").alias("symptom"), F.col("repair_card.patch_intent.text").alias("patch"))


@query(TURNS_SQL + f"SELECT id, left(trim(regexp_replace(text, {SQL_WS}, ' ', 'g')), 800) AS issue_excerpt, 'src/m.py,tests/test_m.py' AS files FROM u")
def wiki(spark, sf_dir):
    return cards.wiki(turn_records(spark, sf_dir)).select("id", F.col("wiki.source_context.issue_excerpt").alias("issue_excerpt"), F.array_join("files", ",").alias("files"))


@query("SELECT * FROM " + fx.sql_values(fx.CARDS, "id, card, overall, bug_fix_score"))
def record_cards(spark, sf_dir):
    c = cards.repair_cards(fx.records(spark))
    return c.select("id", F.to_json("repair_card").alias("card"), "quality.overall", "quality.bug_fix_score")


def all_cards(spark, sf_dir):
    both = turn_records(spark, sf_dir).unionByName(fx.records(spark), allowMissingColumns=True)
    return landed(cards.repair_cards(both), "cards")


def _samples(variant: str):
    def run(spark, sf_dir):
        c = all_cards(spark, sf_dir)
        s = exports.repair_samples(c, variant=variant)
        return s.select(F.col("metadata.source_id").alias("id"), F.col("metadata.task_type").alias("task"), "output_kind", "output", F.array_join("metadata.evidence_ids", ",").alias("ids"), F.col("metadata.grounding_ok").alias("grounded"))

    return run


for _v in exports.VARIANTS:
    QUERIES[f"repair_sft_{_v.replace('-', '_')}"] = _samples(_v)


SYMPTOM_SQL = TURNS_SQL + f""", x AS (SELECT u.id, t.turn, t.conv_id, left(trim(regexp_replace(u.text, {SQL_WS}, ' ', 'g')), 300) AS issue FROM u JOIN t ON u.id = t.conv_id || '_' || t.turn),
s AS (SELECT *, CASE WHEN issue = '' THEN 'fix' ELSE 'fix: ' || issue END AS symptom, issue = '' AS blank FROM x)
"""


def turn_cards(spark, sf_dir):
    return landed(cards.repair_cards(turn_records(spark, sf_dir)), "cards")


@query(
    SYMPTOM_SQL
    + """
SELECT id, 'localize_files' AS task, '{"source_files":["src/m.py"],"test_files":["tests/test_m.py"]}' AS output, CASE WHEN blank THEN 'E2,E3' ELSE 'E3,E4' END AS ids, true AS grounded FROM s
UNION ALL SELECT id, 'explain_bug', symptom, CASE WHEN blank THEN 'E1' ELSE 'E1,E2' END, true FROM s
UNION ALL SELECT id, 'repair_rationale', 'src/m.py: added lines=1, removed lines=1', CASE WHEN blank THEN 'E2' ELSE 'E3' END, true FROM s
UNION ALL SELECT id, 'test_spec', 'tests/test_m.py: added lines=1, removed lines=0', CASE WHEN blank THEN 'E3' ELSE 'E4' END, true FROM s
UNION ALL SELECT id, 'repair_instruction', 'Update src/m.py so the behavior described by the issue is fixed and the relevant tests pass.', CASE WHEN blank THEN 'E2,E3' ELSE 'E3,E4' END, true FROM s
"""
)
def repair_sft_turns(spark, sf_dir):
    s = exports.repair_samples(turn_cards(spark, sf_dir))
    return s.select(F.col("metadata.source_id").alias("id"), F.col("metadata.task_type").alias("task"), "output", F.array_join("metadata.evidence_ids", ",").alias("ids"), F.col("metadata.grounding_ok").alias("grounded"))


@query(
    SYMPTOM_SQL
    + """
SELECT id, 'acme/tool' AS repo, 'Repository: acme/tool' || chr(10) || chr(10) || 'PR: ' || turn || chr(10) || chr(10) || 'Issue: ' || (conv_id + 1) || chr(10) || chr(10) || 'Problem Summary: ' || trim(symptom) AS head, true AS has_test_evidence FROM s
"""
)
def repair_corpus_turns(spark, sf_dir):
    c = exports.corpus_records(turn_cards(spark, sf_dir))
    return c.select("id", "repo", F.regexp_extract("text", r"(?s)^(.*?)\n\nEvidence:\n", 1).alias("head"), "metadata.has_test_evidence")


@query()
def repair_corpus(spark, sf_dir):
    c = all_cards(spark, sf_dir)
    return exports.corpus_records(c, policy="semantic").select("id", "repo", "text", "metadata.*")


@query("SELECT * FROM " + fx.sql_values(fx.LLM_GROUNDING, "id, invalid, field_coverage, grounded_claims, total_claims, grounding_ok"))
def llm_grounding(spark, sf_dir):
    c = cards.repair_cards(fx.records(spark))
    answer = F.lit('Here: {"root_cause": {"text": " wrong  index ", "evidence_ids": ["E1", "EX"]}, "failure_condition": {"text": "empty input", "evidence_ids": ["E1"]}, "edge_cases": [{"text": "", "evidence_ids": []}]}')
    g = cards.grounding(c.withColumn("llm_repair_card", cards.parse_llm_card(answer)))
    return g.select("id", F.array_join("llm_quality.invalid_evidence_ids", ",").alias("invalid"), "llm_quality.field_coverage", "llm_quality.grounded_claims", "llm_quality.total_claims", "llm_quality.grounding_ok")


# --- tasks ---

TREE = [
    ("r", "calc.py", 'def add(a, b):\n    """Sum."""\n    return a + b\n\n\ndef _hidden():\n    return 1\n\n\nclass Box:\n    def area(self):\n        return 1\n'),
    ("r", "src/pkg/util.py", "def slug(x):\n    return x.lower()\n"),
    ("r", "tests/test_calc.py", "import calc\nfrom calc import add, _hidden, Box\nfrom pkg import util\n\n\nclass T:\n    def test_add(self):\n        assert add(1, 2) == calc.add(2, 1)\n        _hidden()\n        Box.area(Box())\n        util.slug('A')\n"),
    ("r", "tests/test_broken.py", "def test_x(:\n"),
]


@query("SELECT * FROM " + fx.sql_values(fx.AST_REFS, "module, function, target_class, confidence, selectors"))
def ast_refs(spark, sf_dir):
    files = fx.relation(spark, TREE, "repo string, path string, content string")
    r = tasks.reference_table(files)
    return r.select("module", "function", "target_class", "confidence", F.array_join("test_selectors", ",").alias("selectors"))


@query("SELECT * FROM " + fx.sql_values(fx.COMPLETION, "id, target_file, target_symbol, target_class, test_command, content"))
def completion_tasks(spark, sf_dir):
    files = fx.relation(spark, TREE, "repo string, path string, content string")
    return tasks.completion_tasks(files, tasks.completion_targets(files, methods=True), check_baseline=False).select("id", "target_file", "target_symbol", "target_class", "test_command", "content")


@query("SELECT * FROM " + fx.sql_values(fx.UNIFIED_DIFF, "path, diff"))
def unified_diff(spark, sf_dir):
    files = fx.relation(spark, TREE, "repo string, path string, content string").select("path", "content")
    return policy.workspace_diff(files, files.withColumn("content", F.replace("content", F.lit("return"), F.lit("yield"))))


@query()
def mbpp_tasks(spark, sf_dir):
    from ..sources import datasets

    return tasks.mbpp_tasks(datasets.mbpp_seed(spark)).unionByName(tasks.humaneval_tasks(datasets.humaneval_seed(spark))).unionByName(tasks.benchmark_tasks(datasets.benchmark_seed(spark)))

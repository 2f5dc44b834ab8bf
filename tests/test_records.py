from pyspark.sql import functions as F

from repairlake.operators import cards, evaluation, exports, manifests, scoring, selection, traces
from repairlake.plans import fixtures as fx


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_scores(spark):
    s = by_id(scoring.with_quality(fx.records(spark)))
    assert s["acme_1"].is_bug_fix and s["acme_1"].bug_fix_score == 3 + 1 + 1 + 0.5 + 1 + 0.5
    assert s["acme_1"].source_files == ["src/parser.py"] and s["acme_1"].test_files == ["tests/test_parser.py"]
    assert s["acme_2"].docs_only and not s["acme_2"].is_bug_fix
    assert s["acme_3"].dependency_only and s["acme_4"].tests_only
    assert s[""].bug_fix_score == 0 and s[""].bug_fix_reasons == [] and not s[""].docs_only


def test_cards(spark):
    c = by_id(cards.repair_cards(fx.records(spark)))
    one = c["acme_1"]
    assert [e.type for e in one.evidence] == ["issue_text", "pr_text", "source_diff", "test_diff"] and [e.id for e in one.evidence] == ["E1", "E2", "E3", "E4"]
    assert one.evidence[0].anchor == "issue#12" and "\n" not in one.evidence[2].text
    assert one.quality.overall > 0.9 and one.repair_card.symptom.text.startswith("Crash on empty input: ")
    assert one.repair_card.patch_intent.text == "src/parser.py: added lines=3, removed lines=1"
    assert "poetry.lock" not in str(c["acme_3"].evidence) and c["unknown"].evidence == []
    assert {r.id for r in cards.repair_cards(fx.records(spark), 0.9).collect()} == {"acme_1"}
    w = by_id(cards.wiki(fx.records(spark)))
    assert w["acme_1"].metadata is None and w["acme_1"].wiki.change_summary.startswith("Patch touches src/parser.py, tests/test_parser.py")


def answered(spark, text):
    c = cards.repair_cards(fx.records(spark)).where("id = 'acme_1'")
    return cards.grounding(c.withColumn("llm_repair_card", cards.parse_llm_card(F.lit(text))))


def test_grounding(spark):
    bad = answered(spark, '{"root_cause": {"text": "x", "evidence_ids": ["EX"]}}').first().llm_quality
    assert bad.invalid_evidence_ids == ["EX"] and not bad.grounding_ok and bad.field_coverage == 0.2
    good = answered(spark, 'ok {"root_cause": {"text": "x", "evidence_ids": ["E1"]}, "edge_cases": [{"text": "e", "evidence_ids": ["E2"]}]}').first().llm_quality
    assert good.grounding_ok and good.grounded_claims == 2 and good.field_coverage == 0.4
    assert not answered(spark, "no json").first().llm_quality.valid_json


def test_enrichment_isolates_failures(spark):
    def model(system, prompt):
        if "acme_2" in prompt:
            raise RuntimeError("down")
        return '{"root_cause": {"text": "x", "evidence_ids": ["E1"]}}'

    got = by_id(cards.enrich(cards.repair_cards(fx.records(spark)).where("id in ('acme_1', 'acme_2')"), model))
    assert got["acme_1"].llm_quality.grounding_ok and "down" in got["acme_2"].llm_quality.error


def test_samples_and_corpus(spark, tmp_path):
    path = str(tmp_path / "cards")
    answered(spark, '{"root_cause": {"text": "no guard", "evidence_ids": ["E1"]}, "expected_behavior": {"text": "None", "evidence_ids": ["E4"]}}').write.parquet(path)
    c = spark.read.parquet(path)
    full = {r.metadata.task_type: r for r in exports.repair_samples(c).collect()}
    assert set(full) == set(exports.TASKS) and full["explain_bug"].output == "Root cause: no guard\nExpected behavior: None"
    assert full["repair_instruction"].output == "Fix src/parser.py: no guard. None"
    assert full["localize_files"].output_kind == "object" and all(r.metadata.grounding_ok for r in full.values())
    fewer = {r.metadata.task_type: r for r in exports.repair_samples(c, variant="no-tests").collect()}
    assert set(fewer) == set(exports.TASKS) - {"test_spec"} and '"test_files":[]' in fewer["localize_files"].output
    assert exports.repair_samples(c, min_quality=2.0).count() == 0
    only = {r.metadata.task_type: r for r in exports.repair_samples(c, variant="diff-only").collect()}
    assert only["explain_bug"].metadata.evidence_ids == ["E2", "E3"]
    record = exports.corpus_records(c, require_grounding=True).first()
    assert record.text.startswith("Repository: acme/tool\n\nPR: 1 https://example.org/1\n\nIssue: 12\n\n") and "Root Cause: no guard" in record.text
    stats = cards.card_stats(c).first()
    assert stats.records == 1 and stats.llm_grounding_ok == 1


def test_unknown_options_fail(spark):
    import pytest

    c = cards.repair_cards(fx.records(spark))
    for wrong in ({"variant": "x"}, {"tasks": ("x",)}, {"policy": "x"}):
        with pytest.raises(ValueError):
            exports.repair_samples(c, **wrong)


def test_selection(spark):
    r = scoring.with_quality(fx.records(spark)).withColumn("seq", F.monotonically_increasing_id())
    twice = r.unionByName(r)
    got = selection.select_cards(twice, 5, 0.5)
    assert [x.id for x in got.collect()] == ["acme_1"]
    assert selection.selected_records(twice, got).count() == 2
    rows = spark.range(100).toDF("task_id")
    parts = [{x.task_id for x in selection.shard(rows, i, 3, "task_id").collect()} for i in range(3)]
    assert parts == [set(range(i, 100, 3)) for i in range(3)]
    assert selection.not_completed(rows, spark.range(90).toDF("task_id")).count() == 10


def event(trace, seq, kind, **payload):
    result = payload.pop("result", None)
    return trace, seq, kind, {**payload, "result": result}


def make_events(spark):
    ok, bad = {"ok": True, "error_type": ""}, {"ok": False, "error_type": "test_failed"}
    rows = []
    for trace, noisy in (("a", False), ("b", True)):
        rows += [event(trace, 0, "run_started", task="t"), event(trace, 1, "plan", plan="p"), event(trace, 2, "tool_call", tool="read_file", result=ok, format_violation=noisy), event(trace, 3, "tool_call", tool="run_tests", result=ok), event(trace, 4, "run_finished", outcome="success", elapsed_ms=5.0)]
    rows += [event("c", 0, "tool_call", tool="run_tests", result=bad), event("d", 0, "run_started", task="t")]
    return spark.createDataFrame(rows, f"trace string, seq bigint, event string, payload {traces.PAYLOAD}")


def test_traces(spark):
    e = make_events(spark)
    assert traces.sft_samples(e, strict=True).count() == 2 and traces.sft_samples(e, clean_steps=True).count() == 3 and traces.sft_samples(e).count() == 4
    s = {(r.trace, r.seq): r for r in traces.sft_samples(e).collect()}
    assert s["a", 3].input.task == "t" and s["a", 3].input.plan == "p" and [h.tool for h in s["a", 3].input.history] == ["read_file"] and s["a", 2].input.history == []
    stats = traces.run_stats(e).first()
    assert (stats.total_runs, stats.successes, stats.pass_rate, stats.format_violation_rate) == (4, 2, 0.5, 0.2)
    assert {r.trace: r.outcome for r in traces.classify_outcomes(e).collect()} == {"a": "success", "b": "success", "c": "test_failed", "d": "no_actions"}
    assert {(r.kind, r.name): r.n for r in traces.run_outcomes(e).collect()}["outcome", "missing_outcome"] == 2


def test_manifests(spark):
    r = spark.createDataFrame([("mbpp", False, "success"), ("mbpp", False, "test_failed"), (None, True, None)], "source string, skipped boolean, outcome string")
    got = {x.source: x for x in manifests.manifest_stats(r).collect()}
    assert got["mbpp"].pass_rate == 0.5 and got["unknown"].skipped == 1
    rows = spark.createDataFrame([(i, "r" if i else "", "t") for i in range(5)], "seq bigint, repo string, task string")
    plan = [(x.action, x.emitted) for x in manifests.plan_manifest(rows, limit=2).orderBy("seq").collect()]
    assert plan == [("skip", True), ("run", True), ("run", True), ("skip", False), ("skip", False)]


def test_evaluation(spark):
    r = spark.createDataFrame([("a", True, 0, 0), ("a", False, 1, 0), ("b", False, 0, 1), ("", True, 0, 2)], "task_id string, ok boolean, shard int, seq int")
    got = evaluation.pass_at_1(r).first()
    assert (got.total, got.passed, got.pass_at_1) == (2, 1, 0.5)
    assert evaluation.code_of("x ```python\n  def f():\n    pass\n``` y") == "def f():\n  pass"
    assert evaluation.code_of("Sure.\ndef f():\n    return 1\n# Tests:\nassert f()") == "def f():\n    return 1"

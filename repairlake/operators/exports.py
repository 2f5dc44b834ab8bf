"""Training samples and corpus text from repair cards. Narrow projections; the tasks of a card are one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diffs, text
from ..functions.records import EVIDENCE, INSUFFICIENT, LLM_CARD, LLM_QUALITY, completed, or_empty

VARIANTS = ("full", "no-llm", "no-tests", "diff-only")
TASKS = ("explain_bug", "localize_files", "repair_instruction", "repair_rationale", "test_spec")
DIFF_TYPES = ("source_diff", "test_diff", "other_diff")
ALLOWED = {"diff-only": ("pr_text", "source_diff", "other_diff"), "no-tests": ("issue_text", "pr_text", "source_diff", "other_diff")}
OPTIONAL = {"llm_repair_card": LLM_CARD, "llm_quality": LLM_QUALITY, "evidence": EVIDENCE}


def usable(claim: Column) -> Column:
    return F.coalesce((claim["text"] != "") & (claim["text"] != INSUFFICIENT), F.lit(False))


def said(claim: Column) -> Column:
    """A claim's text; empty where it has none or says that evidence is insufficient."""
    return F.when(usable(claim), claim["text"]).otherwise(F.lit(""))


def ids_in(claims: list[Column]) -> Column:
    """Non-empty ids of claims, each once, in their order."""
    every = F.flatten(F.array(*[or_empty(c["evidence_ids"]) for c in claims]))
    return F.array_distinct(F.filter(every, lambda i: i.isNotNull() & (i != "")))


def evidence_lines(evidence: Column, policy: str) -> Column:
    """Evidence as headed paragraphs."""
    file = lambda e: F.when(text.text_of(e["file"]) != "", F.concat(F.lit(" "), e["file"])).otherwise("")
    each = lambda e: F.concat(F.lit("["), e["id"], F.lit(": "), e["type"], file(e), F.lit("]\n"), text.clean_text(text.text_of(e["text"]), policy))
    return F.array_join(F.transform(evidence, each), "\n\n")


def diff_only_summary(evidence: Column) -> Column:
    """What pull-request text and diffs alone tell of the bug."""
    part = (
        lambda e: F.when(e["type"] == "pr_text", F.substring(text.strip(text.text_of(e["text"])), 1, 300))
        .when(e["type"].isin("source_diff", "other_diff"), text.strip(F.concat(text.text_of(e["file"]), F.lit(": "), diffs.summarize_evidence(text.text_of(e["text"])))))
        .otherwise("")
    )
    parts = F.filter(F.transform(evidence, part), lambda x: x != "")
    return text.filled(text.strip(F.array_join(parts, " ")), F.lit("Use the PR and source diff evidence to infer the repair."))


def _instruction(variant: str) -> Column:
    files = F.when(F.size("source_files") > 0, F.col("source_files")).otherwise(or_empty(F.col("repair_card.localization.source_files")))
    target = F.when(F.size(files) > 0, text.join_values(F.slice(files, 1, 5))).otherwise("the affected source files")
    if variant == "diff-only":
        return text.strip(F.concat(F.lit("Update "), target, F.lit(" according to the PR/source diff evidence. Preserve the intended source behavior: "), F.col("_diff_only")))
    llm = lambda f: said(F.col(f"_llm.{f}"))
    details = F.filter(F.array(*[llm(f) for f in ("root_cause", "failure_condition", "expected_behavior", "repair_rationale")]), lambda t: t != "")
    rest = F.array_join(F.slice(details, 2, 2), " ")
    fix = text.strip(F.concat(F.lit("Fix "), target, F.lit(": "), F.get(details, F.lit(0)), F.lit("."), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")))
    return F.when(F.size(details) > 0, fix).otherwise(text.text_of("derived_tasks.repair_instruction.output"))


def repair_samples(cards: DataFrame, tasks=TASKS, variant: str = "full", policy: str = "light", min_quality: float = 0.0, require_grounding: bool = False) -> DataFrame:
    """Samples (instruction, input, output, output_kind, metadata) of cards, a row for each task with an output.
    output is text, or JSON where output_kind is object (localize_files). Grounded: at least one id, and all of them
    in the evidence of the variant."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    if wrong := [t for t in tasks if t not in TASKS]:
        raise ValueError(f"unknown tasks: {', '.join(wrong)}")
    c = completed(cards, OPTIONAL).withColumn("_overall", F.coalesce(F.col("quality.overall"), F.lit(0.0))).where(F.col("_overall") >= min_quality)
    evidence = F.coalesce(F.col("evidence"), F.array().cast(EVIDENCE))
    if variant in ALLOWED:
        evidence = F.filter(evidence, lambda e: e["type"].isin(*ALLOWED[variant]))
    c = c.withColumns({"_evidence": evidence, "_llm": F.col("llm_repair_card") if variant == "full" else F.lit(None).cast(LLM_CARD)})
    c = c.withColumns({"_text": evidence_lines(F.col("_evidence"), policy), "_valid": F.array_compact(F.transform("_evidence", lambda e: e["id"])), "_diff_only": diff_only_summary(F.col("_evidence"))})
    without_tests = variant in ALLOWED
    claim, card = (lambda f: F.col(f"_llm.{f}")), (lambda f: F.col(f"repair_card.{f}"))
    own_ids = lambda f: or_empty(card(f)["evidence_ids"])

    def sample(task: str) -> Column:
        kind = F.lit("text")
        if task == "localize_files":
            kind = F.lit("object")
            tests = F.array().cast("array<string>") if without_tests else F.coalesce(card("localization")["test_files"], or_empty(F.col("test_files")))
            out = F.to_json(F.struct(F.coalesce(card("localization")["source_files"], or_empty(F.col("source_files"))).alias("source_files"), tests.alias("test_files")))
            ids, asked = own_ids("localization"), "Identify the source and test files involved in fixing the bug."
        elif task == "explain_bug":
            claims = [claim(f) for f in ("failure_condition", "root_cause", "expected_behavior")]
            lines = F.array(*[F.when(usable(x), F.concat(F.lit(f"{label}: "), x["text"])) for label, x in zip(("Failure condition", "Root cause", "Expected behavior"), claims, strict=True)])
            told = F.array_join(F.array_compact(lines), "\n")
            out = F.when(told != "", told).otherwise(text.text_of(card("symptom")["text"]))
            ids, asked = F.when(told != "", ids_in(claims)).otherwise(own_ids("symptom")), "Explain the bug using only the provided evidence."
            if variant == "diff-only":
                out, ids = F.col("_diff_only"), F.filter(F.transform("_evidence", lambda e: text.text_of(e["id"])), lambda i: i != "")
        elif task == "repair_rationale":
            own = claim("repair_rationale")
            out = F.when(usable(own), own["text"]).otherwise(text.text_of(card("patch_intent")["text"]))
            ids, asked = F.when(usable(own), or_empty(own["evidence_ids"])).otherwise(own_ids("patch_intent")), "Describe why the patch fixes the bug."
        elif task == "test_spec":
            expected, cases = claim("expected_behavior"), F.coalesce(claim("edge_cases"), F.array().cast("array<struct<text: string, evidence_ids: array<string>>>"))
            first = F.array_compact(F.array(F.when(usable(expected), F.concat(F.lit("Expected behavior: "), expected["text"]))))
            more = F.transform(F.filter(cases, usable), lambda x: F.concat(F.lit("Edge case: "), x["text"]))
            told = F.array_join(F.concat(first, more), "\n")
            out = F.when(told != "", told).otherwise(text.text_of(card("test_oracle")["text"]))
            every = F.array_distinct(F.filter(F.concat(or_empty(expected["evidence_ids"]), F.flatten(F.transform(cases, lambda x: or_empty(x["evidence_ids"])))), lambda i: i != ""))
            ids, asked = F.when(told != "", every).otherwise(own_ids("test_oracle")), "Summarize the expected behavior and edge cases from the test evidence."
            if without_tests:
                out = F.lit("")
        else:
            out = _instruction(variant)
            every = ids_in([claim(f) for f in ("root_cause", "failure_condition", "expected_behavior", "repair_rationale")])
            ids, asked = F.when(F.size(every) > 0, every).otherwise(own_ids("localization")), "Write a concise repair instruction for a coding agent."
        ids = F.filter(ids, lambda i: i.isNotNull() & (i != ""))
        if without_tests:
            ids = F.filter(ids, lambda i: F.array_contains(F.col("_valid"), i))
        return F.struct(F.lit(task).alias("task"), F.lit(asked).alias("asked"), kind.alias("kind"), out.alias("out"), ids.alias("ids"))

    every = c.select("id", "repo", "_text", "_valid", "_overall", F.array(*[sample(t) for t in tasks]).alias("_all"))
    c = every.select("id", "repo", "_text", "_valid", "_overall", F.explode("_all").alias("_s")).where("_s.out <> ''")
    c = c.withColumn("_grounded", (F.size("_s.ids") > 0) & (F.size(F.array_except("_s.ids", "_valid")) == 0))
    if require_grounding:
        c = c.where("_grounded")
    source, repo = text.text_of("id"), text.text_of("repo")
    return c.select(
        F.col("_s.asked").alias("instruction"),
        F.struct(repo.alias("repo"), source.alias("source_id"), F.col("_text").alias("evidence")).alias("input"),
        F.col("_s.out").alias("output"),
        F.col("_s.kind").alias("output_kind"),
        F.struct(
            F.col("_s.task").alias("task_type"), source.alias("source_id"), repo.alias("repo"), F.col("_overall").alias("quality"),
            F.col("_s.ids").alias("evidence_ids"), F.col("_grounded").alias("grounding_ok"), F.lit(variant).alias("variant"),
        ).alias("metadata"),
    )


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("0"))


def _flag(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), "True").otherwise("False")


def corpus_records(cards: DataFrame, min_quality: float = 0.0, require_grounding: bool = False, max_evidence_chars: int = 1200, raw_diffs: bool = False, policy: str = "light") -> DataFrame:
    """(id, repo, text, metadata): a labelled text for each card, secrets redacted. Grounded means here that the
    model's card was found grounded."""
    c = completed(cards, OPTIONAL)
    grounded = F.coalesce(F.col("llm_quality.grounding_ok"), F.lit(False))
    c = c.where(F.coalesce(F.col("quality.overall"), F.lit(0.0)) >= min_quality)
    if require_grounding:
        c = c.where(grounded)
    llm, card = (lambda f: said(F.col(f"llm_repair_card.{f}"))), (lambda f: said(F.col(f"repair_card.{f}")))
    c = c.withColumns({"_symptom": text.clean_text(card("symptom"), policy), "_oracle": card("test_oracle"), "_intent": card("patch_intent")})
    file = lambda e: F.when(text.text_of(e["file"]) != "", F.concat(F.lit(" "), e["file"])).otherwise("")
    cut = lambda e: F.substring(text.clean_text(text.text_of(e["text"]), policy), 1, max_evidence_chars)
    shown = cut if raw_diffs else (lambda e: F.when(e["type"].isin(*DIFF_TYPES), diffs.summarize_evidence(text.text_of(e["text"]))).otherwise(cut(e)))
    line = lambda e: F.concat(F.lit("- ["), text.text_of(e["id"]), F.lit(": "), text.text_of(e["type"]), file(e), F.lit("] "), shown(e))
    c = c.withColumn("_evidence", F.array_join(F.transform(F.coalesce(F.col("evidence"), F.array().cast(EVIDENCE)), line), "\n"))
    cases = F.filter(F.transform(F.coalesce(F.col("llm_repair_card.edge_cases"), F.array().cast("array<struct<text: string, evidence_ids: array<string>>>")), said), lambda t: t != "")
    label = lambda name, *values: F.concat(F.lit(f"{name}: "), *values)
    none = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
    trimmed = lambda v: F.regexp_replace(v, r"\s+$", "")
    q = F.col("quality")
    parts = F.array(
        label("Repository", text.text_of("repo")),
        trimmed(label("PR", none(F.col("source_record.pr_number")), F.lit(" "), text.text_of("source_record.pr_url"))),
        trimmed(label("Issue", none(F.col("source_record.issue_number")))),
        label("Problem Summary", F.col("_symptom")),
        F.concat(F.lit("Evidence:\n"), F.col("_evidence")),
        label("Changed source files", text.join_values(or_empty(F.col("source_files")))),
        label("Changed test files", text.join_values(or_empty(F.col("test_files")))),
        label("Symptom", F.col("_symptom")),
        label("Root Cause", text.filled(llm("root_cause"), F.col("_symptom"))),
        label("Failure Condition", text.filled(llm("failure_condition"), F.col("_symptom"))),
        label("Expected Behavior", text.filled(llm("expected_behavior"), F.col("_oracle"))),
        label("Patch Intent / Repair Rationale", text.filled(llm("repair_rationale"), F.col("_intent"))),
        label("Test Oracle", F.col("_oracle")),
        label("Edge Cases", F.when(F.size(cases) > 0, text.join_values(cases)).otherwise(INSUFFICIENT)),
        label(
            "Validation / Quality signals",
            text.join_values(
                F.array(
                    F.concat(F.lit("quality.overall="), _number(q["overall"])),
                    F.concat(F.lit("bug_fix_score="), _number(q["bug_fix_score"])),
                    F.concat(F.lit("has_test_evidence="), _flag(q["has_test_evidence"])),
                    F.concat(F.lit("has_source_patch="), _flag(q["has_source_patch"])),
                    F.concat(F.lit("llm_grounding_ok="), _flag(grounded)),
                    card("validation"),
                )
            ),
        ),
    )
    return c.select(
        text.text_of("id").alias("id"),
        text.text_of("repo").alias("repo"),
        text.redact(F.array_join(F.filter(parts, lambda p: text.strip(p) != ""), "\n\n")).alias("text"),
        F.struct(
            F.coalesce(q["overall"], F.lit(0.0)).alias("quality"), F.coalesce(q["bug_fix_score"], F.lit(0.0)).alias("bug_fix_score"),
            F.coalesce(q["has_test_evidence"], F.lit(False)).alias("has_test_evidence"), grounded.alias("grounding_ok"),
        ).alias("metadata"),
    )

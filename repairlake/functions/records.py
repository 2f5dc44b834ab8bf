"""The shape of pull-request records and of what is made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = {
    "id": "string",
    "repo": "string",
    "pr_number": "bigint",
    "pr_title": "string",
    "pr_body": "string",
    "pr_url": "string",
    "issue_number": "bigint",
    "issue_title": "string",
    "issue_body": "string",
    "diff": "string",
    "files": "array<string>",
    "test_command": "string",
    "bug_fix_score": "double",
    "bug_fix_reasons": "array<string>",
    "source_files": "array<string>",
    "test_files": "array<string>",
}
CLAIM = "struct<text: string, evidence_ids: array<string>>"
EVIDENCE = "array<struct<id: string, type: string, text: string, file: string, anchor: string>>"
LLM_CARD = f"struct<root_cause: {CLAIM}, failure_condition: {CLAIM}, expected_behavior: {CLAIM}, repair_rationale: {CLAIM}, edge_cases: array<{CLAIM}>>"
LLM_QUALITY = "struct<valid_json: boolean, all_evidence_ids_valid: boolean, invalid_evidence_ids: array<string>, field_coverage: double, grounded_claims: int, total_claims: int, grounding_ok: boolean, error: string>"
INSUFFICIENT = "insufficient_evidence"


def completed(df: DataFrame, shape: dict[str, str]) -> DataFrame:
    """df with every column of shape, cast to its type; those that it lacks are null. Others stay."""
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in shape.items()})


def or_empty(values) -> F.Column:
    return F.coalesce(values, F.array().cast("array<string>"))

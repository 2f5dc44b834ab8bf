"""Bug-fix scores of pull-request records, and the filters that use them.

Everything is one narrow projection: no shuffle, no Python. Expensive parts (lines, files, tokens, hits) are
columns of their own, which Catalyst does not inline where they are used more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diffs, paths, text
from ..functions.records import RECORD, completed

QUALITY_FIELDS = (
    "is_bug_fix", "bug_fix_score", "bug_fix_reasons", "source_files", "test_files", "docs_only", "tests_only",
    "dependency_only", "low_signal_only", "large_patch", "issue_pr_consistency",
)


def overlap_share(a: Column, b: Column) -> Column:
    """The overlap coefficient of two token arrays to three digits; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.round(F.size(F.array_intersect(a, b)) / least, 3)).otherwise(F.lit(0.0))


def bug_fix_quality(
    records: DataFrame, positive=text.POSITIVE_KEYWORDS, negative=text.NEGATIVE_KEYWORDS, into: str = "bug_fix_quality"
) -> DataFrame:
    """records with a struct of QUALITY_FIELDS added. Missing record columns count as null. Columns pass through
    whatever their names; those beginning with __bug_ are reserved."""
    joined = lambda *cs, sep: F.concat_ws(sep, *[text.text_of(c) for c in cs])
    r = completed(records, RECORD)
    names = [f"`{c}`" for c in r.columns]
    r = r.withColumn("__bug_diff", text.text_of("diff"))
    r = r.withColumns({"__bug_files": F.when(F.size("files") > 0, F.col("files")).otherwise(diffs.files_of(F.col("__bug_diff"))), "__bug_lines": text.split_lines(F.col("__bug_diff"))})
    r = r.withColumns(
        {
            "__bug_source": F.filter("__bug_files", paths.is_source),
            "__bug_test": F.filter("__bug_files", paths.is_test),
            "__bug_any": F.size("__bug_files") > 0,
            "__bug_changed": diffs.count_lines(F.col("__bug_lines"), "+") + diffs.count_lines(F.col("__bug_lines"), "-"),
            "__bug_text": joined("pr_title", "pr_body", "issue_title", "issue_body", sep="\n"),
            "__bug_issue": joined("issue_title", "issue_body", sep=" "),
            "__bug_pr": text.without_reference_noise(joined("pr_title", "pr_body", sep=" ")),
        }
    )
    both = (text.strip(F.col("__bug_issue")) != "") & (text.strip(F.col("__bug_pr")) != "")
    r = r.withColumns({"__bug_issue_tokens": text.meaningful_tokens(F.col("__bug_issue")), "__bug_pr_tokens": text.meaningful_tokens(F.col("__bug_pr"))})
    r = r.withColumns(
        {
            "__bug_up": text.keyword_hits(F.col("__bug_text"), positive),
            "__bug_up_diff": text.keyword_hits(diffs.changed_text(F.col("__bug_diff")), positive),
            "__bug_down": text.keyword_hits(F.col("__bug_text"), negative),
            "__bug_same": F.when(both, overlap_share(F.col("__bug_issue_tokens"), F.col("__bug_pr_tokens"))).otherwise(F.lit(0.0)),
            "__bug_docs": F.col("__bug_any") & F.forall("__bug_files", paths.is_docs_or_config),
            "__bug_tests": F.col("__bug_any") & (F.size("__bug_test") > 0) & (F.size("__bug_source") == 0),
            "__bug_dependency": F.col("__bug_any") & F.forall("__bug_files", paths.is_dependency),
            "__bug_low": F.col("__bug_any") & F.forall("__bug_files", lambda p: paths.is_low_signal(p) | paths.is_docs_or_config(p)),
            "__bug_huge": (F.size("__bug_files") > 30) | (F.col("__bug_changed") > 1800),
        }
    )
    linked = F.coalesce(F.col("issue_number") != 0, F.lit(False))
    told = linked & ((text.text_of("issue_title") != "") | (text.text_of("issue_body") != ""))
    words = lambda label, hits: F.concat(F.lit(label), F.array_join(F.slice(hits, 1, 5), ", "))
    has = lambda c: F.size(c) > 0
    rules = [
        (has("__bug_up"), F.least(F.lit(3), F.size("__bug_up")).cast("double"), words("positive text keywords: ", F.col("__bug_up"))),
        (has("__bug_up_diff"), F.lit(1.0), words("positive diff keywords: ", F.col("__bug_up_diff"))),
        (linked, F.lit(1.0), F.lit("linked issue")),
        (told & (F.col("__bug_same") >= 0.12), F.lit(0.5), F.lit("issue and PR text are consistent")),
        (told & (F.col("__bug_same") < 0.04), F.lit(-1.5), F.lit("issue and PR text are weakly aligned")),
        (has("__bug_source"), F.lit(1.0), F.lit("touches source files")),
        (has("__bug_test") & has("__bug_source"), F.lit(0.5), F.lit("touches tests with source")),
        (has("__bug_down"), F.lit(-3.0), words("negative keywords: ", F.col("__bug_down"))),
        (F.col("__bug_docs"), F.lit(-4.0), F.lit("docs or CI/config only")),
        (F.col("__bug_tests"), F.lit(-3.0), F.lit("tests only")),
        (F.col("__bug_dependency"), F.lit(-4.0), F.lit("dependency files only")),
        (F.col("__bug_low") & ~has("__bug_source"), F.lit(-3.0), F.lit("low-signal generated/vendor/config files only")),
        (F.col("__bug_huge"), F.lit(-2.0), F.lit("very large patch")),
    ]
    score = F.lit(0.0)
    for when, points, _ in rules:
        score = score + F.when(when, points).otherwise(F.lit(0.0))
    r = r.withColumns({"__bug_score": score, "__bug_reasons": F.array_compact(F.array(*[F.when(when, said) for when, _, said in rules]))})
    fix = (F.col("__bug_score") >= 2) & ~F.col("__bug_docs") & ~F.col("__bug_tests") & ~F.col("__bug_dependency") & ~(F.col("__bug_low") & ~has("__bug_source"))
    values = (fix, F.col("__bug_score"), F.col("__bug_reasons"), F.col("__bug_source"), F.col("__bug_test"), F.col("__bug_docs"), F.col("__bug_tests"), F.col("__bug_dependency"), F.col("__bug_low"), F.col("__bug_huge"), F.col("__bug_same"))
    made = r.withColumn(into, F.struct(*[v.alias(n) for n, v in zip(QUALITY_FIELDS, values, strict=True)]))
    return made.select(*names, into)


def with_quality(records: DataFrame) -> DataFrame:
    """records with the fields of their score as columns, in place of any they had."""
    made = bug_fix_quality(records, into="__bug_quality")
    return made.withColumns({c: F.col(f"__bug_quality.{c}") for c in QUALITY_FIELDS}).drop("__bug_quality")


def bug_fixes_only(scored: DataFrame, keep_docs: bool = False, keep_tests: bool = False) -> DataFrame:
    """Bug fixes among scored records; documentation or tests alone only where asked for."""
    kept = F.col("is_bug_fix")
    if keep_docs:
        kept = kept | F.col("docs_only")
    if keep_tests:
        kept = kept | F.col("tests_only")
    return scored.where(kept)


def text_prefilter(title, body, min_hits: int = 1, positive=text.POSITIVE_KEYWORDS, negative=text.NEGATIVE_KEYWORDS, strong=("fix", "bug", "regression", "error", "failure")) -> Column:
    """A cheap look at a pull request before its diff is fetched."""
    both = F.concat(text.text_of(title), F.lit("\n"), text.text_of(body))
    up, down = text.keyword_hits(both, positive), text.keyword_hits(both, negative)
    return (F.size(up) >= min_hits) & ((F.size(down) == 0) | F.arrays_overlap(up, F.array(*map(F.lit, strong))))


def high_quality(min_score: float) -> Column:
    """Scored records that are worth a card: source and tests changed, and nothing that speaks against them."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return (
        (F.coalesce("bug_fix_score", F.lit(0.0)) >= min_score)
        & F.coalesce("is_bug_fix", F.lit(False))
        & (F.size("source_files") > 0)
        & (F.size("test_files") > 0)
        & no("docs_only") & no("tests_only") & no("dependency_only") & no("low_signal_only") & no("large_patch")
    )


def first_by_id(rows: DataFrame, *order: str, key: str = "id") -> DataFrame:
    """The first row (in that order) of each key that is neither null nor empty. The limit of the window works
    before the shuffle, so that a key of many rows sends one row from each task."""
    marked = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    w = Window.partitionBy(key).orderBy(*order)
    return marked.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def cached_union(records: DataFrame, *order: str) -> DataFrame:
    """Records of several caches: the first of each id, its link read anew from the text (issue texts of another
    link are dropped) and its score made anew."""
    first = completed(first_by_id(records, *order), RECORD)
    link = text.linked_issue("pr_title", "pr_body").cast("bigint")
    same = link.eqNullSafe(F.col("issue_number"))
    sane = first.withColumns({"__bug_link": link, "__bug_same": same})
    sane = sane.withColumns({c: F.when(F.col("__bug_same"), F.col(c)).otherwise(F.lit("")) for c in ("issue_title", "issue_body")} | {"issue_number": F.col("__bug_link")})
    return with_quality(sane.drop("__bug_link", "__bug_same"))

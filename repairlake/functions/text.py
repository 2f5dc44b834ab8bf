"""Text columns: spacing, ids, keywords, issue references, cleaning of pull-request text, redaction.

White space and line ends are written out, because regex dialects differ on them: WS is what Python calls
white space and LINE_END what ends a line there. Words end where no letter, digit or underscore follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[\t-\r\x1c-\x1f \x85\xa0  -     　]"
NOT_WS = "[^" + WS[1:]
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
STARTS, ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: What closes an issue, what speaks for and against a bug fix, words without weight.
CLOSING_VERBS = ("fix", "fixes", "fixed", "close", "closes", "closed", "resolve", "resolves", "resolved")
POSITIVE_KEYWORDS = (
    "fix", "fixed", "fixes", "bug", "regression", "error", "exception", "crash", "failing", "failure", "fail", "broken",
    "incorrect", "wrong", "issue", "defect", "flaky", "traceback", "TypeError", "ValueError", "AssertionError",
)
NEGATIVE_KEYWORDS = (
    "docs", "documentation", "typo", "spelling", "refactor", "cleanup", "style", "formatting", "dependency bump", "release",
    "changelog", "ci", "test-only",
)
STOPWORDS = (
    "about", "after", "against", "also", "and", "are", "before", "being", "between", "but", "can", "does", "for", "from",
    "has", "have", "into", "not", "should", "that", "the", "this", "through", "when", "where", "with", "without", "would",
)
#: Parts of pull-request templates.
TEMPLATE_HEADINGS = ("AI Assistance Disclosure", "Checklist", "Backport")
NEXT_HEADINGS = (
    "Trac ticket number", "Branch description", "Problem", "Description", "Reproduction", "Steps to reproduce",
    "Expected behavior", "Actual behavior", "Test plan", "Tests", "Validation", "Summary",
)
CHECKBOX_FRAGMENTS = (
    "contribution guidelines",
    "does not disclose a security vulnerability",
    "targets the `main` branch",
    "targets the main branch",
    "commit message is written in past tense",
    "please select exactly one",
    "no ai tools were used",
    "if ai tools were used",
    "fully reviewed and verified their output",
    "automated ai review",
    "has patch",
    "attached screenshots",
    "added or updated relevant docs",
)
TEMPLATE_SENTENCES = (
    r"Backports will be evaluated and done by mergers[^.]*\.?",
    r"see vulnerability reporting[^.]*\.?",
    r"This PR follows the contribution guidelines[^.]*\.?",
    r"This PR targets the `?main`? branch[^.]*\.?",
)
SECTION_HEADINGS = (
    "Trac ticket number", "Branch description", "Steps to reproduce", "Expected behavior", "Actual behavior", "Test plan",
    "Tests run", r"AI Assistance Disclosure(?:\s*\([^)]*\))?", "Checklist", "Backport", "Validation", "Description",
    "Reproduction", "Problem", "Summary", "Tests",
)
KEPT_SECTIONS = (
    "", "title", "summary", "description", "problem", "branch description", "reproduction", "steps to reproduce",
    "actual behavior", "expected behavior", "test plan", "tests", "tests run", "validation",
)
SECRET_PATTERNS = (r"sk-[A-Za-z0-9_-]{12,}", r"(?:ghp|github_pat|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{12,}", r"Bearer\s+[A-Za-z0-9._-]{16,}")

POLICIES = ("keep", "light", "strict", "semantic")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row. Inside lambdas Catalyst shares nothing, so that an
    expression that a lambda only refers to would otherwise be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(value) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def filled(*values) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(text_of(v), F.lit("")) for v in values], F.lit(""))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()`-" else c for c in text)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{WS}+|{WS}+(?!.|\n)", "")


def compact(value) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(value), f"{WS}+", " "))


def split_lines(value: Column) -> Column:
    """The lines of a text; the end of the last line starts no further one."""
    return let(F.split(value, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def safe_id(value) -> Column:
    return filled(F.btrim(F.regexp_replace(text_of(value), "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("item"))


def safe_name(value) -> Column:
    return filled(F.substring(F.regexp_replace(text_of(value), r"[^\p{L}\p{N}]", "_"), 1, 120), F.lit("task"))


def summarize(title: Column, body: Column) -> Column:
    short = compact(body)
    return F.when(short != "", F.concat(title, F.lit(": "), F.substring(short, 1, 300))).otherwise(title)


def without_html_comments(value: Column) -> Column:
    return F.regexp_replace(value, "(?s)<!--.*?-->", " ")


def without_reference_noise(value: Column) -> Column:
    """Without HTML comments, fenced and inline code."""
    fenced = F.regexp_replace(without_html_comments(value), "(?s)```.*?```", " ")
    return F.regexp_replace(fenced, "`[^`]*`", " ")


def linked_issue(title, body) -> Column:
    """The number of the issue that the text closes, int; null if none."""
    text = without_reference_noise(F.concat(text_of(title), F.lit("\n"), text_of(body)))
    verbs = "|".join(CLOSING_VERBS)
    named = rf"(?iU){STARTS}(?:{verbs}){WS}*:?{WS}+(?:[\w.-]+/[\w.-]+)?#([0-9]+){ENDS}"
    linked = rf"(?iU){STARTS}(?:{verbs}){WS}*:?{WS}+https://github\.com/[^/\s]+/[^/\s]+/issues/([0-9]+){ENDS}"
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (named, linked)]
    return F.coalesce(*found).cast("int")


def keyword_hits(value: Column, keywords=POSITIVE_KEYWORDS) -> Column:
    """The keywords that the text holds as whole words, in the order of the list."""
    pattern = {k: STARTS + _literal(k.lower()).replace(" ", WS + "+") + ENDS for k in dict.fromkeys(keywords)}
    # a plain search for the first word goes before the pattern
    held = lambda low, k, p: F.contains(low, F.lit(k.lower().split()[0])) & F.regexp_like(low, F.lit(p))
    return let(F.lower(value), lambda low: F.array_compact(F.array(*[F.when(held(low, k, p), F.lit(k)) for k, p in pattern.items()])))


def meaningful_tokens(value: Column) -> Column:
    """Distinct identifiers of at least three characters in lower case, without stopwords."""
    found = F.transform(F.regexp_extract_all(value, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def without_template_sections(value: Column) -> Column:
    """From a template heading to the next semantic markdown heading or the end, for each of the headings."""
    following = "|".join(NEXT_HEADINGS)
    for heading in TEMPLATE_HEADINGS:
        pattern = rf"(?isU)(?:^|\s)(?:#+\s*)?{_literal(heading)}(?:\s*\([^)]*\))?.*?(?=(?:\s#+\s*(?:{following})\b)|$)"
        value = F.regexp_replace(value, pattern, " ")
    return value


def without_checkboxes(value: Column) -> Column:
    fragments = "|".join(map(_literal, CHECKBOX_FRAGMENTS))
    noisy = lambda line: F.regexp_like(line, F.lit(rf"^{WS}*[-*]{WS}*\[[ xX]\]")) & F.regexp_like(line, F.lit(f"(?i){fragments}"))
    out = F.array_join(F.filter(split_lines(value), lambda x: ~noisy(x)), "\n")
    for f in CHECKBOX_FRAGMENTS:
        out = F.regexp_replace(out, rf"(?iU)[-*]?\s*\[[ xX]\]?\s*[^.]*{_literal(f)}[^.]*\.?", " ")
    # without a box there is nothing to take out
    return F.when(F.regexp_like(value, F.lit(r"\[[ xX]")), out).otherwise(F.array_join(split_lines(value), "\n"))


def without_template_sentences(value: Column) -> Column:
    for p in TEMPLATE_SENTENCES:
        value = F.regexp_replace(value, f"(?iU){p}", " ")
    return value


def normalize_heading(value: Column) -> Column:
    return F.lower(compact(F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), "[^A-Za-z0-9 ]+", " ")))


def markdown_sections(value: Column) -> Column:
    """array<struct<heading, body>> of a text with known headings of two to six marks, with what stands before
    the first under an empty heading; empty where there is no such heading."""
    heading = rf"(?iU)(?:^|\s)#{{2,6}}\s+(?:{'|'.join(SECTION_HEADINGS)})\b"
    own = rf"(?isU)^\s?#{{2,6}}\s+({'|'.join(SECTION_HEADINGS)})\b(.*)"

    def cut(part: Column) -> Column:
        known = F.regexp_like(part, F.lit(own))
        body = F.when(known, F.regexp_extract(part, own, 2)).otherwise(part)
        return F.struct(known.alias("known"), strip(F.regexp_extract(part, own, 1)).alias("heading"), strip(body).alias("body"))

    def named(parts: Column) -> Column:
        kept = F.filter(parts, lambda s: F.exists(parts, lambda t: t["known"]) & (s["known"] | (s["body"] != "")))
        return F.transform(kept, lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body")))

    return let(F.transform(F.split(value, f"(?={heading})", -1), cut), named)


def semantic_sections(value: Column) -> Column:
    """Only sections of meaning; the text as it is where it has no known heading or none is kept."""
    shown = lambda s: F.when(s["heading"] == "", s["body"]).otherwise(strip(F.concat(s["heading"], F.lit(" "), s["body"])))
    kept = F.filter(markdown_sections(value), lambda s: normalize_heading(s["heading"]).isin(*KEPT_SECTIONS))
    joined = let(F.transform(kept, shown), lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n")))
    return F.when(F.regexp_like(value, F.lit("##")), F.coalesce(joined, value)).otherwise(value)


def clean_text(value: Column, policy: str = "light") -> Column:
    """Pull-request text without template parts. keep changes nothing, not even spacing."""
    if policy not in POLICIES:
        raise ValueError(f"unknown boilerplate policy: {policy}")
    if policy == "keep":
        return value
    out = without_checkboxes(without_template_sections(without_html_comments(value)))
    if policy in ("strict", "semantic"):
        out = without_template_sentences(out)
    if policy == "semantic":
        out = semantic_sections(out)
    return compact(out)


def redact(value: Column) -> Column:
    for p in SECRET_PATTERNS:
        value = F.regexp_replace(value, p, "[REDACTED]")
    return value


def join_values(values: Column) -> Column:
    """Non-empty values joined by a comma and a space."""
    return F.array_join(F.filter(values, lambda v: v != ""), ", ")


def function_name(code: Column) -> Column:
    """The first function that a column-0 def names; empty if none."""
    return F.regexp_extract(code, r"(?dm)^def\s+([A-Za-z_]\w*)\s*\(", 1)


def function_skeleton(code: Column) -> Column:
    """The first one-line signature with an empty body, or a stub of any arguments."""
    signature = F.regexp_extract(code, r"(?dm)^def\s+\w+\s*\([^\n]*\)(?:\s*->\s*[^:\n]+)?:", 0)
    return F.when(signature != "", F.concat(signature, F.lit("\n    pass\n"))).otherwise(F.lit("def solution(*args, **kwargs):\n    pass\n"))


def json_object(value: Column) -> Column:
    """A text's JSON object as text: the whole, or from its first to its last brace; null if there is none."""
    whole = F.try_parse_json(value)
    inner = F.regexp_extract(value, r"(?s)\{.*\}", 0)
    pick = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))
    return F.coalesce(pick(whole), pick(F.try_parse_json(F.nullif(inner, F.lit("")))))


def is_raw_json_object(value: Column) -> Column:
    bare = strip(text_of(value))
    return F.coalesce(bare.startswith("{") & bare.endswith("}") & F.try_parse_json(bare).isNotNull(), F.lit(False))

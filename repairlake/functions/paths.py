"""Kinds of repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names, endings and folders that tell kinds of files.
DEPENDENCY_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pdm.lock", "requirements.txt", "go.sum",
    "cargo.lock", "gemfile.lock",
)
LOW_SIGNAL_ENDINGS = (".lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "go.sum", ".min.js", ".min.css")
LOW_SIGNAL_FOLDERS = ("/vendor/", "/dist/", "/build/", "/generated/", "/node_modules/", "/migrations/")
DOC_NAMES = ("readme", "readme.md", "changelog", "changelog.md", "changes", "changes.md", "license", "license.md")


def _one_of(values) -> str:
    return "|".join("".join("\\" + c if not (c.isalnum() or c in "_/-") else c for c in v) for v in values)


#: One pattern a kind, over paths in lower case: small expressions plan fast where they are used in lambdas.
NAMED = rf"(^|/)({_one_of(DEPENDENCY_NAMES)})/*$"
TEST = r"^tests?/|/tests?/|(^|/)test_[^/]*/*$|(_test\.py|\.(test|spec)\.[jt]s)/*$"
DOCS = (
    rf"^(docs|doc|\.github|github)/|(^|/)({_one_of(DOC_NAMES)})/*$|(^|/)(readme|changelog|changes)\.[^/]*/*$"
    r"|\.(md|rst|txt|adoc)$|^(?=.*(workflow|ci)).*\.ya?ml$"
)
LOW_SIGNAL = rf"{NAMED}|({_one_of(LOW_SIGNAL_ENDINGS)})$|(^|/)({_one_of(f.strip('/') for f in LOW_SIGNAL_FOLDERS)})/"


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def ends(path: Column, endings) -> Column:
    return F.regexp_like(path, F.lit(f"({_one_of(endings)})$"))


def is_test(path: Column) -> Column:
    return F.regexp_like(F.lower(path), F.lit(TEST))


def is_docs_or_config(path: Column) -> Column:
    return F.regexp_like(F.lower(path), F.lit(DOCS))


def is_dependency(path: Column) -> Column:
    return F.regexp_like(F.lower(path), F.lit(rf"{NAMED}|\.(lock|sum)$"))


def is_low_signal(path: Column) -> Column:
    return F.regexp_like(F.lower(path), F.lit(LOW_SIGNAL))


def is_source(path: Column) -> Column:
    return (path != "") & ~F.regexp_like(F.lower(path), F.lit(f"{TEST}|{DOCS}|{LOW_SIGNAL}"))

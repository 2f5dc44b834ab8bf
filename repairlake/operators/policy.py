"""Predicates of the sandbox policy over columns: analytics of what would be allowed, not a security boundary."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.paths import any_of
from ..functions.text import compact, let, text_of

#: What commands may begin with and must not hold, and what may not be written.
DANGEROUS = ("rm -rf", "sudo", "curl ", "wget ", "| sh", "| bash", "mkfs", "dd ", "chmod -R 777")
ALLOWED = (
    "pytest", "python -m pytest", "python3 -m pytest", "python -m unittest", "python3 -m unittest", "npm test",
    "npm run test", "pnpm test", "yarn test",
)
IGNORED_FOLDERS = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules", ".venv", "venv")
PROTECTED_NAMES = (".env", ".env.local", "id_rsa", "id_ed25519")


def command_verdict(command) -> Column:
    """allowed, dangerous or not_allowlisted. The search for dangerous parts is in lower case on both sides' terms:
    a part with capitals is never found."""
    bare = compact(command)
    normal = F.when(bare == "", "pytest -q").otherwise(bare)
    bad = any_of([F.contains(F.lower(normal), F.lit(p)) for p in DANGEROUS])
    good = any_of([normal.startswith(p) for p in ALLOWED])
    return F.when(bad, "dangerous").when(good, "allowed").otherwise("not_allowlisted")


def write_verdict(path) -> Column:
    """allowed, escapes (the path leaves the workspace), protected or internal, for paths inside a workspace. A step up
    takes back the folder before it, so that what counts is where the path leads. A null or empty path is the
    workspace itself: allowed."""
    parts = F.filter(F.split(text_of(path), "/"), lambda p: (p != "") & (p != "."))

    def step(a: Column, p: Column) -> Column:
        up, depth = p == "..", F.size(a["at"])
        return F.struct(
            F.when(~up, F.concat(a["at"], F.array(p))).when(depth > 0, F.slice(a["at"], F.lit(1), depth - 1)).otherwise(a["at"]).alias("at"),
            (a["out"] | (up & (depth == 0))).alias("out"),
        )

    def judged(led: Column) -> Column:
        name = F.coalesce(F.try_element_at(led["at"], F.lit(-1)), F.lit(""))
        return (
            F.when(text_of(path).startswith("/") | led["out"], "escapes")
            .when(name.isin(*PROTECTED_NAMES), "protected")
            .when(F.exists(led["at"], lambda p: p.isin(*IGNORED_FOLDERS)), "internal")
            .otherwise("allowed")
        )

    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    return let(F.aggregate(parts, start, step), judged)


def container_command(workspace: Column, command: Column, image: str, network: str = "none", memory: str = "1g", cpus: str = "1") -> Column:
    """The arguments that run a command in a container, as an array."""
    fixed = ["docker", "run", "--rm", "--network", network, "--memory", memory, "--cpus", cpus, "--pids-limit", "256", "-v"]
    return F.concat(F.array(*map(F.lit, fixed)), F.array(F.concat(workspace, F.lit(":/workspace")), F.lit("-w"), F.lit("/workspace"), F.lit(image), F.lit("sh"), F.lit("-lc"), command))


def grep_lines(files, pattern: str, most: int = 80):
    """(path, line_no, line) of files (path, content) whose line matches, the first so many by path and line."""
    from ..functions.text import split_lines

    each = files.select("path", F.posexplode(split_lines(F.col("content"))).alias("n", "line"))
    found = each.where(F.regexp_like("line", F.lit(pattern))).select("path", (F.col("n") + 1).alias("line_no"), "line")
    return found.orderBy("path", "line_no").limit(most)


def file_list(files, most: int = 150):
    """(path) of files outside ignored folders, in order, the first so many, and where there are more a last row that says so."""
    parts = F.split("path", "/")
    first = files.where(~F.exists(parts, lambda p: p.isin(*IGNORED_FOLDERS))).select("path").orderBy("path").limit(most + 1)
    place = F.row_number().over(Window.orderBy("path"))  # of most + 1 rows
    return first.withColumn("place", place).select(F.when(F.col("place") > most, F.lit("... truncated")).otherwise(F.col("path")).alias("path"))


def read_text(content: Column, most: int = 12000) -> Column:
    return F.when(content.isNull(), None).when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n... truncated"))).otherwise(content)


def replace_once(content: Column, old: Column, new: Column) -> Column:
    """struct<ok, occurrences, content>: the text with the one occurrence replaced, unchanged unless there is exactly one."""
    times = F.when(F.length(old) > 0, ((F.length(content) - F.length(F.replace(content, old, F.lit("")))) / F.length(old)).cast("int")).otherwise(0)
    ok = times == 1
    return F.struct(ok.alias("ok"), times.alias("occurrences"), F.when(ok, F.replace(content, old, new)).otherwise(content).alias("content"))


def unified_diff(path: Column, before: Column, after: Column) -> Column:
    """A unified diff with a/ and b/ headers; Python's difflib, a text at a time."""

    @F.pandas_udf("string")
    def made(paths, old, new):
        import difflib

        import pandas as pd

        out = []
        for p, a, b in zip(paths, old, new, strict=True):
            out.append("\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{p}", f"b/{p}", lineterm="")))
        return pd.Series(out, dtype=object)

    return made(path, before, after)


def workspace_diff(source, workspace):
    """(path, diff) of files (path, content) that differ; files only in the workspace differ from nothing, files that
    are gone are not seen."""
    old = source.select("path", F.col("content").alias("_old"))
    both = workspace.join(old, "path", "left").where(F.coalesce("_old", F.lit("")) != F.col("content"))
    return both.select("path", unified_diff(F.col("path"), F.coalesce("_old", F.lit("")), F.col("content")).alias("diff"))

"""Unified diffs as columns. All work is inside one row's arrays of lines; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import LOW_SIGNAL_ENDINGS, any_of, ends, is_low_signal
from .text import join_values, let, split_lines, strip

HEADER = "(?dm)^diff --git a/(.*?) b/(.*?)$"
LINE_HEADER = r"^diff --git a/(.*?) b/(.*?)(?!.|\n)"
#: An evidence text keeps at most so many lines of a patch.
EVIDENCE_LINES = 90


def files_of(diff: Column) -> Column:
    """Paths of a diff in the order of their headers, each once."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(HEADER), F.lit(2)))


def count_lines(lines: Column, sign: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))


def line_counts(diff: Column) -> Column:
    """struct<added, removed>."""
    lines = split_lines(diff)
    return F.struct(count_lines(lines, "+").alias("added"), count_lines(lines, "-").alias("removed"))


def changed_text(diff: Column) -> Column:
    """The added and removed lines."""
    keep = lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---"))
    return F.array_join(F.filter(split_lines(diff), keep), "\n")


def file_patches(diff: Column) -> Column:
    """array<struct<path, lines>> by first header. Lines before the first header belong to none; a further header
    of the same path adds its lines without itself."""

    def heads_of(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, LINE_HEADER, 2).alias("path"), (x.startswith("diff --git ") & F.regexp_like(x, F.lit(LINE_HEADER))).alias("is")))
        return F.struct(lines.alias("lines"), F.filter(marked, lambda m: m["is"]).alias("heads"))

    def cut(x: Column) -> Column:
        lines, heads = x["lines"], x["heads"]
        part = lambda h, k: F.struct(h["path"].alias("path"), F.slice(lines, h["i"] + 1, F.coalesce(F.get(heads, k + 1)["i"], F.size(lines)) - h["i"]).alias("lines"))
        return F.struct(F.transform(heads, part).alias("parts"), F.array_distinct(F.transform(heads, lambda h: h["path"])).alias("paths"))

    def joined(x: Column) -> Column:
        own = lambda path: F.transform(F.filter(x["parts"], lambda p: p["path"] == path), lambda p, k: F.when(k == 0, p["lines"]).otherwise(F.slice(p["lines"], 2, F.size(p["lines"]))))
        united = F.transform(x["paths"], lambda path: F.struct(path.alias("path"), F.flatten(own(path)).alias("lines")))
        return F.when(F.size(x["paths"]) == F.size(x["parts"]), x["parts"]).otherwise(united)

    return let(let(let(split_lines(diff), heads_of), cut), joined)


def _counts_text(added: Column, removed: Column) -> Column:
    return F.concat(F.lit("added lines="), added.cast("string"), F.lit(", removed lines="), removed.cast("string"))


def summarize_diff(diff: Column) -> Column:
    files, lines = files_of(diff), split_lines(diff)
    said = F.concat(F.lit("Patch touches "), F.array_join(F.slice(files, 1, 8), ", "), F.lit("; "), _counts_text(count_lines(lines, "+"), count_lines(lines, "-")), F.lit("."))
    return F.when(F.size(files) > 0, said).otherwise(F.lit("No unified diff was provided; use issue and PR text to infer the repair."))


def summarize_files(diff: Column, patches: Column, selected: Column) -> Column:
    """The counts of selected paths in the order of the diff; of the whole diff where none is in it."""
    own = F.filter(patches, lambda p: F.array_contains(selected, p["path"]))
    each = F.transform(own, lambda p: F.concat(p["path"], F.lit(": "), _counts_text(count_lines(p["lines"], "+"), count_lines(p["lines"], "-"))))
    return F.when(F.size(own) > 0, F.array_join(each, "; ")).otherwise(summarize_diff(diff))


def is_binary(patch: Column) -> Column:
    low = F.lower(patch)
    return F.contains(low, F.lit("binary files ")) | F.contains(low, F.lit("git binary patch"))


def is_low_signal_line(line: Column) -> Column:
    noise = lambda bare: F.regexp_like(bare, F.lit(r"^[{}\[\],:0-9A-Fa-fx_.\"' -]+(?!.|\n)"))
    return let(strip(F.regexp_replace(line, "^[+-]", "")), lambda bare: (bare == "") | (F.length(bare) > 500) | ((F.length(bare) > 120) & noise(bare)))


def clean_patch(path: Column, lines: Column, most: int = EVIDENCE_LINES) -> Column:
    """A patch's headers and telling lines. The end is the first changed or context line at or after the line
    that fills the limit; what is left out is counted in a last line (with lines skipped or of low signal
    counted again at the end, as the count is over all lines of the patch)."""
    kind = (
        lambda x: F.when(F.regexp_like(x, F.lit("^(index |similarity index |rename from |rename to )")), "S")
        .when(F.regexp_like(x, F.lit("^(diff --git |--- |\\+\\+\\+ |@@)")), "H")
        .when(F.regexp_like(x, F.lit("^[+-]")), F.when(is_low_signal_line(x), "L").otherwise("K"))
        .otherwise(F.when(strip(x) != "", "C").otherwise("B"))
    )
    marked = let(lines, lambda own: F.transform(own, lambda x, i: F.struct(i.alias("i"), kind(x).alias("k"), x.alias("x"))))
    full = lambda m: F.struct(m.alias("m"), F.get(F.filter(m, lambda y: y["k"].isin("H", "K", "C")), F.lit(most - 1))["i"].alias("full"))
    end = lambda s: F.struct(s["m"].alias("m"), s["full"].alias("full"), F.get(F.filter(s["m"], lambda y: y["k"].isin("K", "C", "B") & (y["i"] >= s["full"])), F.lit(0))["i"].alias("end"))
    late = lambda s, y: F.coalesce(y["i"] > s["full"], F.lit(False))

    def parts(s: Column) -> Column:
        until = lambda y: s["end"].isNull() | (y["i"] <= s["end"])
        kept = F.filter(s["m"], lambda y: until(y) & (y["k"].isin("H", "K") | ((y["k"] == "C") & ~late(s, y))))
        left = F.size(F.filter(s["m"], lambda y: until(y) & (y["k"].isin("L", "B") | ((y["k"] == "C") & late(s, y)))))
        return F.struct(F.transform(kept, lambda y: y["x"]).alias("texts"), left.alias("left"), s["end"].isNotNull().alias("cut"), F.size(s["m"]).alias("n"))

    def said(s: Column) -> Column:
        omitted = s["left"] + F.when(s["cut"], F.greatest(F.lit(0), s["n"] - F.size(s["texts"]))).otherwise(0)
        note = F.concat(F.lit("... omitted "), omitted.cast("string"), F.lit(" low-signal or excess diff lines ..."))
        return strip(F.array_join(F.when(omitted > 0, F.array_append(s["texts"], note)).otherwise(s["texts"]), "\n"))

    out = let(let(let(let(marked, full), end), parts), said)
    return F.when(is_low_signal(path) | is_binary(F.array_join(lines, "\n")), F.lit("")).otherwise(out)


def is_binary_or_low_signal_diff(diff: Column) -> Column:
    """A diff of binary parts, or of files that all end or lie where little is said (node_modules is not among these)."""
    files = F.transform(_header_paths(diff), F.lower)
    folders = ("/vendor/", "/dist/", "/build/", "/generated/", "/migrations/")
    low = lambda p: ends(p, LOW_SIGNAL_ENDINGS) | any_of([F.contains(F.concat(F.lit("/"), p), F.lit(f)) for f in folders])
    return is_binary(diff) | ((F.size(files) > 0) & F.forall(files, low))


def _header_paths(diff: Column) -> Column:
    heads = F.filter(split_lines(diff), lambda x: F.regexp_like(x, F.lit(LINE_HEADER)))
    return F.transform(heads, lambda x: F.regexp_extract(x, LINE_HEADER, 2))


def summarize_evidence(diff: Column) -> Column:
    """Files, hunks and counts of an evidence text. Evidence is compacted to one line, so that the header's
    second path runs to the end of the text and the counts are 0; texts with line ends are counted in full."""

    def told(lines: Column) -> Column:
        hunks = F.size(F.filter(lines, lambda x: x.startswith("@@")))
        files = join_values(F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(LINE_HEADER))), lambda x: F.regexp_extract(x, LINE_HEADER, 2)))
        named = F.when(files != "", F.concat(F.lit("files="), files, F.lit("; "))).otherwise("")
        return F.concat(named, F.lit("hunks="), hunks.cast("string"), F.lit("; "), _counts_text(count_lines(lines, "+"), count_lines(lines, "-")))

    said = let(split_lines(diff), told)
    return F.when(is_binary_or_low_signal_diff(diff), F.lit("low-signal or binary diff omitted")).otherwise(said)


def is_tests_path(path: Column) -> Column:
    """The narrower test of edits: tests/ in front or inside, test_ in front, _test.py at the end."""
    return path.startswith("tests/") | F.contains(path, F.lit("/tests/")) | path.startswith("test_") | path.endswith("_test.py")


def touches_tests(diff: Column) -> Column:
    named = F.filter(split_lines(diff), lambda x: x.startswith("--- ") | x.startswith("+++ "))
    return F.exists(named, lambda x: is_tests_path(F.regexp_replace(strip(F.substring(x, 5, 1 << 30)), "^[ab]/", "")))


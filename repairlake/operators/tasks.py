"""Runnable tasks from benchmark rows and from repositories with tests.

Source text is parsed by Python's own parser, a file at a time in table functions; everything else (uniting
references, finding modules and symbols, limits) is joins and windows.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, filled, function_name, function_skeleton, safe_id, text_of
from .manifests import DEFAULT_TEST_COMMAND

AGENT_NOTE = "Make the smallest code change. Run tests after editing.\n"


def _stripped_right(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def unit_test_file(function: Column, tests: Column) -> Column:
    """A unittest module of one case for each assertion."""
    cases = F.transform(tests, lambda t, i: F.concat(F.lit("    def test_case_"), (i + 1).cast("string"), F.lit("(self) -> None:\n        "), t, F.lit("\n")))
    return F.concat(_stripped_right(F.concat(F.lit("import unittest\n\nfrom solution import "), function, F.lit("\n\n\nclass GeneratedTests(unittest.TestCase):\n"), F.array_join(cases, "\n"))), F.lit("\n"))


def _manifest(id_: Column, source: Column, task: Column, symbol: Column, solution: Column, tests: Column) -> list[Column]:
    return [
        id_.alias("id"), source.alias("source"), F.concat(F.lit("repos/"), id_).alias("repo"), task.alias("task"), F.lit("solution.py").alias("target_file"),
        symbol.alias("target_symbol"), F.lit(DEFAULT_TEST_COMMAND).alias("test_command"), solution.alias("solution_py"), tests.alias("test_py"),
    ]


def _head(rows: DataFrame, limit: int | None, order: str | None) -> DataFrame:
    if limit is None:
        return rows
    return (rows.orderBy(order) if order else rows).limit(limit)


def benchmark_tasks(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Manifest rows with file contents; a row without a required field or with a null test fails the query."""
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"benchmark record missing field: {c}")))
    tests = F.when(F.forall(need("tests"), lambda t: t.isNotNull()), F.col("tests")).otherwise(F.raise_error(F.lit("benchmark record tests must be a list of strings")))
    code = F.concat(_stripped_right(need("buggy_code")), F.lit("\n"))
    source = filled("source", F.lit("offline_benchmark")) if "source" in rows.columns else F.lit("offline_benchmark")
    return _head(rows, limit, order).select(*_manifest(safe_id(need("id")), source, need("description"), need("function"), code, unit_test_file(need("function"), tests)))


def mbpp_tasks(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    """The limit takes rows before those without code or tests go."""
    r = _head(rows, limit, order).withColumn("_code", F.btrim(text_of("code"), F.lit(" \t\r\n"))).where("_code <> '' and test_list is not null")
    r = r.withColumn("_f", filled(function_name(F.col("_code")), F.lit("solution")))
    task = F.concat(F.lit("Implement `"), F.col("_f"), F.lit("` in solution.py so it satisfies the task: "), text_of("text"))
    return r.select(*_manifest(safe_id(F.concat(F.lit("mbpp_"), F.col("task_id").cast("string"))), F.lit("mbpp"), task, F.col("_f"), function_skeleton(F.col("_code")), unit_test_file(F.col("_f"), F.col("test_list"))))


def humaneval_tasks(rows: DataFrame, limit: int | None = None, order: str | None = None) -> DataFrame:
    r = _head(rows, limit, order).withColumn("_f", F.trim(text_of("entry_point"))).where((F.col("_f") != "") & (text_of("prompt") != "") & (text_of("test") != ""))
    tests = F.concat(F.lit("import unittest\n\nfrom solution import "), F.col("_f"), F.lit("\n\n"), _stripped_right(F.col("test")), F.lit("\n\nclass GeneratedTests(unittest.TestCase):\n    def test_humaneval(self) -> None:\n        check("), F.col("_f"), F.lit(")\n"))
    task = F.concat(F.lit("Implement `"), F.col("_f"), F.lit("` in solution.py so it passes the HumanEval-style tests."))
    return r.select(*_manifest(safe_id(F.col("task_id").cast("string")), F.lit("humaneval"), task, F.col("_f"), F.concat(_stripped_right(F.col("prompt")), F.lit("\n    pass\n")), tests))


def write_repositories(tasks: DataFrame, root: str) -> None:
    """The files of tasks below a folder that executors share, a task a folder."""
    from functools import partial

    tasks.select("repo", "solution_py", "test_py").foreachPartition(partial(_write_all, root))


def _write_all(root: str, rows) -> None:
    from pathlib import Path

    for r in rows:
        base = Path(root, r.repo)
        (base / "tests").mkdir(parents=True, exist_ok=True)
        (base / "solution.py").write_text(r.solution_py, encoding="utf-8")
        (base / "tests/test_solution.py").write_text(r.test_py, encoding="utf-8")
        (base / "AGENT.md").write_text(AGENT_NOTE, encoding="utf-8")


# --- references of tests to code ---

REFERENCE = (
    "seq int, module string, function string, target_class string, fallback_module string, fallback_class string, alias string, access_path string,"
    " test_class string, test_name string, confidence double, original_import string"
)
SYMBOL = "class string, name string"


def _parsed(content: str | None) -> ast.Module | None:
    try:
        return ast.parse(content or "")
    except (SyntaxError, ValueError):
        return None


def _imports(tree: ast.Module) -> dict[str, tuple[str, str | None, str]]:
    """Local names: (module, imported name or None, the import as written). The last import of a name counts."""
    out: dict[str, tuple[str, str | None, str]] = {}
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                for a in names:
                    out[a.asname or a.name.split(".")[0]] = (a.name, None, f"import {a.name}" + (f" as {a.asname}" if a.asname else ""))
            case ast.ImportFrom(module=str(module), names=names, level=0):
                for a in names:
                    if a.name != "*":
                        out[a.asname or a.name] = (module, a.name, f"from {module} import {a.name}" + (f" as {a.asname}" if a.asname else ""))
    return out


def _chain(node: ast.expr) -> list[str]:
    """a.b.c as its names; names before a call or an index are lost."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return [node.id, *names] if isinstance(node, ast.Name) else names


def _tests(body: list[ast.stmt], owner: str = ""):
    for node in body:
        if isinstance(node, ast.ClassDef):
            yield from _tests(node.body, node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and node.name.startswith("test"):
            yield owner, node


def test_references(content: str | None) -> list[tuple]:
    """Rows of REFERENCE for the calls in test functions of a file that lead to an import."""
    tree = _parsed(content)
    if tree is None:
        return []
    known, out = _imports(tree), []
    for owner, test in _tests(tree.body):
        for call in (n for n in ast.walk(test) if isinstance(n, ast.Call)):
            names = _chain(call.func) if isinstance(call.func, ast.Name | ast.Attribute) else []
            if not names or names[0] not in known:
                continue
            module, name, written = known[names[0]]
            found = None
            if len(names) == 1:
                found = (module, name, None, None, None, 1.0) if name is not None else None
            elif name is None:
                found = (module, names[-1], None, None, None, 0.95)
            elif len(names) == 2:
                found = (f"{module}.{name}", names[1], None, module, name, 0.9)
            elif len(names) == 3:
                found = (module, names[2], name, None, None, 0.75)
            if found:
                m, f, target, fm, fc, sure = found
                out.append((len(out), m, f, target, fm, fc, names[0], ".".join(names), owner, test.name, sure, written))
    return out


def symbols(content: str | None) -> list[tuple[str, str]]:
    """(class, name) of the functions of a file (class empty) and of the methods of its classes."""
    tree = _parsed(content)
    functions = lambda body: [n.name for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    if tree is None:
        return []
    out, seen = [("", n) for n in functions(tree.body)], set()
    for node in tree.body:
        if isinstance(node, ast.ClassDef) and node.name not in seen:
            seen.add(node.name)
            out += [(node.name, n) for n in functions(node.body)]
    return out


def blanked(content: str, function: str, owner: str = "") -> str | None:
    """A file with the body of a function (or of a class's method) replaced by pass; signature, decorators and
    docstring stay. None where it is not there or the file does not parse."""
    lines = content.splitlines()
    tree = _parsed("\n".join(lines) + "\n")
    if tree is None:
        return None
    body = tree.body if not owner else next((n.body for n in tree.body if isinstance(n, ast.ClassDef) and n.name == owner), [])
    node = next((n for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name == function), None)
    if node is None:
        return None
    first = node.body[0]
    documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    rest = node.body[1:] if documented else node.body
    if rest:
        lines[rest[0].lineno - 1 : rest[-1].end_lineno] = [" " * rest[0].col_offset + "pass"]
    else:
        lines.insert(first.end_lineno, " " * (first.col_offset + 4) + "pass")
    return "\n".join(lines).rstrip() + "\n"


def _each_file(files: DataFrame, make, schema: str) -> DataFrame:
    """make(content) -> tuples, for each row of files (repo, path, content), as columns behind repo and path."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(r, p, *t) for r, p, c in zip(pdf["repo"], pdf["path"], pdf["content"], strict=True) for t in make(c)]
            yield pd.DataFrame(rows, columns=["repo", "path", *names])

    return files.select("repo", "path", "content").mapInPandas(run, f"repo string, path string, {schema}")


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def reference_table(files: DataFrame, tests_dir: str = "tests") -> DataFrame:
    """References united by (repo, module, target_class, function): the first one's fields, all its test files and
    selectors in the order of paths and calls, the greatest confidence."""
    own = files.where(F.col("path").startswith(f"{tests_dir}/") & _base(F.col("path")).startswith("test") & F.col("path").endswith(".py"))
    refs = _each_file(own, test_references, REFERENCE)
    module = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    refs = refs.withColumn("selector", F.concat_ws(".", module, F.nullif("test_class", F.lit("")), "test_name"))
    at = F.struct("path", "seq")
    first = F.min_by(F.struct("fallback_module", "fallback_class", "alias", "access_path", "test_class", "test_name", "original_import"), at)
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("path", "seq", F.col(c).alias("v")))), lambda x: x["v"]))
    got = refs.withColumn("target_class", text_of("target_class")).groupBy("repo", "module", "target_class", "function").agg(
        first.alias("f"), F.transform(ordered("path"), lambda x: x).alias("test_files"), ordered("selector").alias("test_selectors"), F.max("confidence").alias("confidence"), F.min(at).alias("at"),
    )
    return got.select("repo", "module", "function", "target_class", "f.*", "test_files", "test_selectors", "confidence", "at")


def imported_functions(files: DataFrame, tests_dir: str = "tests") -> DataFrame:
    """(repo, module, functions) that tests reach without a class."""
    return reference_table(files, tests_dir).where("target_class = ''").groupBy("repo", "module").agg(F.array_sort(F.collect_set("function")).alias("functions"))


def _module_files(refs: DataFrame, files: DataFrame, module: str, into: str) -> DataFrame:
    """refs with the first existing file of a dotted module: itself, its package, or either below src."""
    base = F.replace(F.col(module), F.lit("."), F.lit("/"))
    options = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(F.lit("src/"), base, F.lit(".py")), F.concat(F.lit("src/"), base, F.lit("/__init__.py")))
    wanted = refs.select("repo", F.col(module).alias("_m"), F.posexplode(options).alias("_rank", "path")).where("_m is not null").distinct()
    found = wanted.join(files.select("repo", "path"), ["repo", "path"]).groupBy("repo", "_m").agg(F.min_by("path", "_rank").alias(into))
    return refs.join(found.withColumnRenamed("_m", module), ["repo", module], "left")


def completion_targets(files: DataFrame, tests_dir: str = "tests", min_confidence: float = 0.5, methods: bool = False, exclude_private: bool = True, max_per_file: int = 5) -> DataFrame:
    """Functions of files (repo, path, content) that tests call and whose bodies can be blanked, in the order in which
    tests first reach them, so many a file."""
    refs = reference_table(files, tests_dir).where(F.col("confidence") >= min_confidence)
    if exclude_private:
        refs = refs.where(~F.col("function").startswith("_"))
    if not methods:
        refs = refs.where("target_class = ''")
    refs = _module_files(refs, files, "module", "_own")
    if methods:
        refs = _module_files(refs, files, "fallback_module", "_fallback")
        use = F.col("_own").isNull() & F.col("_fallback").isNotNull()
        refs = refs.withColumns({"module": F.when(use, F.col("fallback_module")).otherwise(F.col("module")), "target_class": F.when(use, F.col("fallback_class")).otherwise(F.col("target_class")), "_own": F.coalesce("_own", "_fallback")})
    known = _each_file(files.where(F.col("path").endswith(".py")), symbols, SYMBOL).distinct()
    here = refs.where("_own is not null").join(known.select("repo", F.col("path").alias("_own"), F.col("class").alias("target_class"), F.col("name").alias("function")), ["repo", "_own", "target_class", "function"], "left_semi")
    once = here.withColumn("_nth", F.row_number().over(Window.partitionBy("repo", "_own", "target_class", "function").orderBy("at"))).where("_nth = 1")
    place = F.row_number().over(Window.partitionBy("repo", "_own").orderBy("at"))
    some = once.withColumn("_place", place).where(F.col("_place") <= max_per_file)
    return some.select("repo", F.col("_own").alias("path"), "module", "function", "target_class", "alias", "access_path", "test_class", "test_name", "test_files", "test_selectors", "confidence", "original_import", "at")


def test_command(selectors: Column, files: Column, fallback: str = DEFAULT_TEST_COMMAND) -> Column:
    modules = F.transform(files, lambda p: F.replace(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit("/"), F.lit(".")))
    run = lambda xs: F.concat(F.lit("python3 -m unittest "), F.array_join(xs, " "))
    return F.when(F.size(selectors) > 0, run(selectors)).when(F.size(modules) > 0, run(modules)).otherwise(fallback)


BASELINE = "ok boolean, output string"


def baseline_checked(tasks: DataFrame, files: DataFrame, timeout: float = 30) -> DataFrame:
    """tasks (repo, test_command, ...) with baseline, a struct<ok, output>: whether the command passes in a copy of the
    repository as it is. A command that can't be run, or not in time, is not ok, and its output says why. A task
    gets its repository's files in one row; each is run by itself on an executor."""
    from .agent import Workspace

    held = files.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("path", F.coalesce("content", F.lit("")).alias("content")))).alias("files"))

    @F.pandas_udf(BASELINE)
    def run(trees, commands):
        import shlex
        import subprocess
        import tempfile
        from pathlib import Path

        import pandas as pd

        rows = []
        for tree, command in zip(trees, commands, strict=True):
            with tempfile.TemporaryDirectory() as folder:
                place = Workspace(Path(folder), dict(tree))
                try:
                    ran = subprocess.run(shlex.split(command), cwd=place.root, env=place.environment(), text=True, capture_output=True, timeout=timeout, check=False)
                    rows.append((ran.returncode == 0, (ran.stdout + "\n" + ran.stderr).strip()))
                except Exception as e:  # noqa: BLE001  told as the check's outcome
                    rows.append((False, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["ok", "output"])

    return tasks.join(held, "repo").withColumn("baseline", run("files", "test_command")).drop("files")


def completion_tasks(files: DataFrame, targets: DataFrame, limit: int | None = None, full_command: str = DEFAULT_TEST_COMMAND, check_baseline: bool = True, timeout: float = 30) -> DataFrame:
    """Manifest rows of targets with the blanked file as content. Targets that can't be blanked, whose blanked file is no
    Python, or (check_baseline) whose tests do not pass before go; limit is applied before that."""

    @F.pandas_udf("string")
    def blank(contents, functions, owners):
        import ast

        import pandas as pd

        out = [blanked(c, f, o or "") for c, f, o in zip(contents, functions, owners, strict=True)]
        for i, made in enumerate(out):
            try:
                ast.parse(made or "")
            except (SyntaxError, ValueError):
                out[i] = None
        return pd.Series(out, dtype=object)

    some = targets.orderBy("repo", "at").limit(limit) if limit is not None else targets
    held = some.join(files.select("repo", "path", "content"), ["repo", "path"]).withColumn("content", blank("content", "function", "target_class")).where("content is not null")
    held = held.withColumn("test_command", test_command(F.col("test_selectors"), F.col("test_files"), full_command))
    if check_baseline:
        held = baseline_checked(held, files, timeout).where("baseline.ok")
    else:
        held = held.withColumn("baseline", F.struct(F.lit(True).alias("ok"), F.lit("").alias("output")))
    owner = F.coalesce("target_class", F.lit(""))
    return held.select(
        safe_id(F.concat(F.lit("unit_"), F.col("module"), F.lit("_"), owner, F.lit("_"), F.col("function"))).alias("id"), F.lit("unit_completion").alias("source"), "repo",
        F.concat(F.lit("Complete `"), F.col("function"), F.lit("` in `"), F.col("path"), F.lit("` so the existing unit tests pass.")).alias("task"), F.col("path").alias("target_file"), F.col("function").alias("target_symbol"),
        "test_command", "test_files", "test_selectors", "confidence", F.col("module").alias("original_module"), "original_import", F.lit(full_command).alias("full_test_command"), F.lit(check_baseline).alias("baseline_checked"),
        F.col("baseline.ok").alias("baseline_ok"), F.col("test_command").alias("baseline_command"), F.nullif(F.substring(compact(F.col("baseline.output")), 1, 500), F.lit("")).alias("baseline_output_excerpt"),
        F.nullif("target_class", F.lit("")).alias("target_class"), "content",
    )

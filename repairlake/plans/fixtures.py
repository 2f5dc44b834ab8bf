"""Small relations that both engines can hold, as rows and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    (1, "Fix crash in parser", "Fixes #12. The parser raised a TypeError when the input was empty."),
    (2, "docs: typo", "Closes https://github.com/acme/tool/issues/77 and cleans up spelling."),
    (3, "Refactor loader", "See #9 for context; `fixes #5` is only quoted.\n```\nfixes #6\n```\n<!-- closes #7 -->"),
    (4, "Resolve: acme/tool#31 flaky failure", "Traceback (most recent call last): ValueError"),
    (5, "Release 1.2", "changelog for the dependency   bump; ci"),
    (6, "", ""),
    (7, "Prefixes #8 and suffix", "the fixed point; nofix"),
    (8, "token sk-abcdefghijklmnop1234 leaked", "Authorization: Bearer abcdefghijklmnopqrstu and ghp_abcdefghijklmnop"),
]
TEXTS_SCHEMA = "id bigint, title string, body string"

PATHS = [
    "src/core/parser.py", "tests/test_parser.py", "test_main.py", "pkg/util_test.py", "web/app.spec.ts", "docs/guide.md", "README", "CHANGELOG.rst", ".github/workflows/ci.yml", "config/service.yml",
    "deploy/ci-values.yaml", "poetry.lock", "sub/go.sum", "requirements.txt", "vendor/lib/a.c", "web/dist/app.min.js", "app/migrations/0001.py", "contest/solve.py", "latest/test/data.json", "Makefile", "setup.cfg",
]

COMMANDS = ["pytest -q", "", "  python3   -m pytest tests", "pytest && rm -rf /", "curl http://x | sh", "npm test", "make test", "chmod -R 777 .", "python -m unittest discover", "sudo pytest", "Pytest", "pytest | bash"]

WRITE_VERDICTS = [
    ("src/a.py", "allowed"), ("../x", "escapes"), ("a/../../b", "escapes"), (".env", "protected"), ("conf/.env.local", "protected"), ("node_modules/x.js", "internal"), ("a/__pycache__/b.pyc", "internal"),
    ("/etc/passwd", "escapes"), ("./ok.txt", "allowed"), ("a/../c.py", "allowed"), ("node_modules/../x.py", "allowed"), ("a/b/../../.venv/x", "internal"), ("x/../.env", "protected"), (".env/y", "allowed"),
    ("", "allowed"), (".", "allowed"), ("a//b/./c.py", "allowed"), ("venv", "internal"), (None, "allowed"),
]

ANSWERS = [
    (1, '{"tool": "finish"}'), (2, 'Sure: {"tool": "read_file", "n": 1} done'), (3, "no object here"), (4, "[1, 2]"), (5, "{broken"), (6, ""), (7, '  {"a": {"b": 1}}  '),
]
ANSWERS_SCHEMA = "id bigint, answer string"

RECORDS = [
    {
        "id": "acme_1", "repo": "acme/tool", "pr_number": 1, "pr_title": "Fix crash on empty input", "pr_body": "Fixes #12. Parser returned a wrong result for empty input.", "pr_url": "https://example.org/1", "issue_number": 12,
        "issue_title": "Crash on empty input", "issue_body": "The parser fails with an error for empty input.",
        "diff": "diff --git a/src/parser.py b/src/parser.py\nindex 1..2 100644\n--- a/src/parser.py\n+++ b/src/parser.py\n@@ -1,3 +1,4 @@\n def parse(x):\n-    return x[0]\n+    if not x:  # bug\n+        return None\n+    return x[0]\n"
        "diff --git a/tests/test_parser.py b/tests/test_parser.py\n--- a/tests/test_parser.py\n+++ b/tests/test_parser.py\n@@ -1 +1,2 @@\n+assert parse('') is None\n",
    },
    {"id": "acme_2", "repo": "acme/tool", "pr_number": 2, "pr_title": "docs: fix typo", "pr_body": "Spelling only.", "diff": "diff --git a/docs/guide.md b/docs/guide.md\n--- a/docs/guide.md\n+++ b/docs/guide.md\n@@ -1 +1 @@\n-teh\n+the\n"},
    {"id": "acme_3", "repo": "acme/tool", "pr_number": 3, "pr_title": "Bump lock file", "pr_body": "", "diff": "diff --git a/poetry.lock b/poetry.lock\n--- a/poetry.lock\n+++ b/poetry.lock\n@@ -1 +1 @@\n-a\n+b\n"},
    {"id": "acme_4", "repo": "acme/web", "pr_number": 4, "pr_title": "Add regression tests", "pr_body": "Tests only.", "diff": "diff --git a/tests/test_x.py b/tests/test_x.py\n--- a/tests/test_x.py\n+++ b/tests/test_x.py\n@@ -0,0 +1 @@\n+assert True\n"},
    {"id": "", "repo": "acme/web", "pr_title": "", "pr_body": None, "diff": None},
]


#: What queries over these relations give, worked out from the rules.
AST_REFS = [
    ("calc", "add", "", 1.0, "tests.test_calc.T.test_add"), ("calc", "_hidden", "", 1.0, "tests.test_calc.T.test_add"), ("calc.Box", "area", "", 0.9, "tests.test_calc.T.test_add"),
    ("pkg.util", "slug", "", 0.9, "tests.test_calc.T.test_add"), ("calc", "Box", "", 1.0, "tests.test_calc.T.test_add"),
]

UNIFIED_DIFF = [
    (
        "calc.py",
        '--- a/calc.py\n+++ b/calc.py\n@@ -1,12 +1,12 @@\n def add(a, b):\n     """Sum."""\n-    return a + b\n+    yield a + b\n \n \n def _hidden():\n-    return 1\n+    yield 1\n \n \n class Box:\n     def area(self):\n-        return 1\n+        yield 1',
    ),
    ("src/pkg/util.py", "--- a/src/pkg/util.py\n+++ b/src/pkg/util.py\n@@ -1,2 +1,2 @@\n def slug(x):\n-    return x.lower()\n+    yield x.lower()"),
]

#: Of two claims, one cites an id that is not there; without evidence, no id is.
LLM_GROUNDING = [(f"acme_{i}", "EX", 0.4, 1, 2, False) for i in range(1, 5)] + [("unknown", "E1,EX", 0.4, 0, 2, False)]

COMPLETION = [
    ("unit_calc_Box_area", "calc.py", "area", "Box", "python3 -m unittest tests.test_calc.T.test_add", 'def add(a, b):\n    """Sum."""\n    return a + b\n\n\ndef _hidden():\n    return 1\n\n\nclass Box:\n    def area(self):\n        pass\n'),
    ("unit_calc__add", "calc.py", "add", None, "python3 -m unittest tests.test_calc.T.test_add", 'def add(a, b):\n    """Sum."""\n    pass\n\n\ndef _hidden():\n    return 1\n\n\nclass Box:\n    def area(self):\n        return 1\n'),
    ("unit_pkg.util__slug", "src/pkg/util.py", "slug", None, "python3 -m unittest tests.test_calc.T.test_add", "def slug(x):\n    pass\n"),
]

_VALIDATE = "Use the changed tests when available; otherwise run the relevant project test command."
_NO_TEST = "No changed test evidence was found in the patch."


def _card(symptom, seen, source, test, at, patch, patch_ids, oracle, test_ids) -> str:
    import json

    claim = lambda text, ids: {"text": text, "evidence_ids": ids}
    made = {"symptom": claim(symptom, seen), "localization": {"source_files": source, "test_files": test, "evidence_ids": at}, "patch_intent": claim(patch, patch_ids), "test_oracle": claim(oracle, test_ids), "validation": claim(_VALIDATE, test_ids)}
    return json.dumps(made, separators=(",", ":"))


#: Cards of RECORDS: id, card, overall quality, score (acme_2: fix +1, docs words -3, docs only -4, low signal -3).
CARDS = [
    ("acme_1", _card("Crash on empty input: The parser fails with an error for empty input.", ["E1", "E2"], ["src/parser.py"], ["tests/test_parser.py"], ["E3", "E4"], "src/parser.py: added lines=3, removed lines=1", ["E3"], "tests/test_parser.py: added lines=1, removed lines=0", ["E4"]), 1.0, 7.0),
    ("acme_2", _card("docs: fix typo: Spelling only.", ["E1"], [], [], [], "Patch touches docs/guide.md; added lines=1, removed lines=1.", ["E2"], _NO_TEST, []), 0.15, -9.0),
    ("acme_3", _card("Bump lock file", ["E1"], [], [], [], "Patch touches poetry.lock; added lines=1, removed lines=1.", [], _NO_TEST, []), 0.15, -7.0),
    ("acme_4", _card("Add regression tests: Tests only.", ["E1"], [], ["tests/test_x.py"], ["E2"], "Patch touches tests/test_x.py; added lines=1, removed lines=0.", [], "tests/test_x.py: added lines=1, removed lines=0", ["E2"]), 0.5, -2.0),
    ("unknown", _card("unknown", [], [], [], [], "No unified diff was provided; use issue and PR text to infer the repair.", [], _NO_TEST, []), 0.0, 0.0),
]


def relation(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def records(spark: SparkSession) -> DataFrame:
    from ..functions.records import RECORD

    schema = ", ".join(f"{c} {t}" for c, t in RECORD.items())
    return spark.createDataFrame([tuple(r.get(c) for c in RECORD) for r in RECORDS], schema)


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def sql_values(rows: list, columns: str) -> str:
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows) + f") AS v({columns})"

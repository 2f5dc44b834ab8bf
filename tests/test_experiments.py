from pyspark.sql import functions as F

from repairlake.operators import cards, experiments, policy, scoring, tasks
from repairlake.plans import fixtures as fx


def test_targets_whose_tests_fail_go(spark):
    """Of two functions the one whose test passes stays, in a flat and in a src layout; the other's test fails before."""
    test = "import unittest\n{0}\n\n\nclass T(unittest.TestCase):\n    def test_add(self):\n        self.assertEqual(add(1, 2), 3)\n\n    def test_sub(self):\n        self.assertEqual(sub(3, 1), 2)\n"
    code = "def add(a, b):\n    return a + b\n\n\ndef sub(a, b):\n    return a + b\n"
    rows = [("flat", "calc.py", code), ("flat", "tests/__init__.py", ""), ("flat", "tests/test_calc.py", test.format("from calc import add, sub"))]
    rows += [("src", "src/pkg/calc.py", code), ("src", "src/pkg/__init__.py", ""), ("src", "tests/__init__.py", None), ("src", "tests/test_calc.py", test.format("from pkg.calc import add, sub"))]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    targets = tasks.completion_targets(files)
    got = sorted(map(tuple, tasks.completion_tasks(files, targets).select("repo", "id", "task", "test_command", "baseline_checked", "baseline_ok", "baseline_command").collect()))
    command = "python3 -m unittest tests.test_calc.T.test_add"
    assert got == [
        ("flat", "unit_calc__add", "Complete `add` in `calc.py` so the existing unit tests pass.", command, True, True, command),
        ("src", "unit_pkg.calc__add", "Complete `add` in `src/pkg/calc.py` so the existing unit tests pass.", command, True, True, command),
    ]
    unchecked = tasks.completion_tasks(files, targets, check_baseline=False).collect()
    assert len(unchecked) == 4 and {(r.baseline_checked, r.baseline_ok, r.baseline_output_excerpt) for r in unchecked} == {(False, True, None)}
    slow = tasks.baseline_checked(spark.createDataFrame([("flat", "python3 -c 'import time; time.sleep(9)'"), ("flat", "no-such-program")], "repo string, test_command string"), files, 1)
    assert {(r.baseline.ok, r.baseline.output.split(":")[0]) for r in slow.collect()} == {(False, "TimeoutExpired"), (False, "FileNotFoundError")}


def test_experiment(spark):
    r = fx.records(spark).where("id <> ''").withColumn("seq", F.monotonically_increasing_id())
    made = experiments.build(r.unionByName(r), 10, 0.5)
    assert [c.id for c in made["cards"].collect()] == ["acme_1"] and [x.id for x in made["selected_records"].collect()] == ["acme_1", "acme_1"]
    s = made["summary"].first()
    assert (s.records_total_before_selection, s.selected_prs, s.repair_cards, s.corpus_records, s.has_test_evidence) == (4, 2, 1, 1, 1) and s.sft_records == made["samples"].count() > 0


def test_texts_and_checks(spark):
    assert experiments.build_summary(2, "a/b") == "count=2\noutput=a/b" and experiments.build_summary(0, "a", "c").endswith("extra=c")
    c = cards.repair_cards(fx.records(spark).where("id = 'acme_1'"))
    said = experiments.card_stats_text(cards.card_stats(c), cards.derived_task_counts(c)).splitlines()
    assert said[:2] == ["files=1", "records=1"] and "has_test_evidence=1 ratio=1.0" in said and said[-1].startswith("derived_tasks=explain_bug:1, localize_files:1")
    programs = spark.createDataFrame([(1, "print('x')"), (2, "1/0"), (3, "import time; time.sleep(9)"), (4, None)], "n int, code string")
    got = {r.n: (r.ok, r.error.splitlines()[-1] if r.error else "") for r in experiments.checked(programs, 2).collect()}
    assert got == {1: (True, ""), 2: (False, "ZeroDivisionError: division by zero"), 3: (False, "timeout"), 4: (True, "")}


def test_split_takes_at_least_one(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    got = experiments.split(rows, 0.01, "k").collect()
    assert [r.split for r in got].count("validation") == 1 and len(got) == 7


def test_scores_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", "Fix", 1, 2, "x")], "id string, pr_title string, _score int, _files int, `a.b` string")
    got = scoring.bug_fix_quality(df)
    assert got.select("_score", "_files", "`a.b`").first()[:] == (1, 2, "x")


def test_listing_says_where_it_stops(spark):
    files = spark.createDataFrame([(f"f{i:03}.py",) for i in range(5)] + [(".git/x",)], "path string")
    assert [r.path for r in policy.file_list(files, 3).collect()] == ["f000.py", "f001.py", "f002.py", "... truncated"] and policy.file_list(files, 5).count() == 5

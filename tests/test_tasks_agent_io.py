import json

import pytest

from repairlake.operators import agent, policy, tasks
from repairlake.plans import catalogue
from repairlake.sources import datasets, github, jsonl


def test_ast(spark):
    files = spark.createDataFrame(catalogue.TREE, "repo string, path string, content string")
    t = {(r.path, r.target_class, r.function): r for r in tasks.completion_targets(files, methods=True).collect()}
    assert set(t) == {("calc.py", "", "add"), ("src/pkg/util.py", "", "slug"), ("calc.py", "Box", "area")}
    assert t["calc.py", "", "add"].test_selectors == ["tests.test_calc.T.test_add"] and t["calc.py", "", "add"].confidence == 1.0
    assert {r.function for r in tasks.completion_targets(files).collect()} == {"add", "slug"}
    assert tasks.blanked('def f():\n    """Doc."""\n    return 1\n', "f") == 'def f():\n    """Doc."""\n    pass\n'
    assert tasks.blanked('class A:\n    def f(self):\n        """Doc."""\n', "f", "A").endswith('"""Doc."""\n            pass\n')
    assert tasks.blanked("def f(:\n", "f") is None and tasks.blanked("x = 1\n", "f") is None


def test_task_rows(spark):
    b = tasks.benchmark_tasks(datasets.benchmark_seed(spark)).collect()
    assert len(b) == 5 and "from solution import subtract" in b[0].test_py and b[0].repo == "repos/repair_subtract"
    m = tasks.mbpp_tasks(datasets.mbpp_seed(spark)).collect()
    assert m[0].target_symbol == "add" and m[0].solution_py == "def add(a, b):\n    pass\n"
    for r in [*b, *m, *tasks.humaneval_tasks(datasets.humaneval_seed(spark)).collect()]:
        compile(r.test_py, r.id, "exec")
        compile(r.solution_py, r.id, "exec")


def test_agent_run(spark):
    files = {"calculator.py": "def subtract(a, b):\n    return a + b  # BUG\n", "tests/test_c.py": "import unittest\nfrom calculator import subtract\n\n\nclass T(unittest.TestCase):\n    def test_s(self):\n        self.assertEqual(subtract(3, 1), 2)\n"}
    rows = [("one", files, "Fix subtract", "python3 -m unittest discover -s tests"), ("two", {}, "Other", "pytest -q")]
    got = agent.run_tasks(spark.createDataFrame(rows, "id string, files map<string,string>, task string, test_command string"), agent.mock_model).orderBy("trace", "seq").collect()
    end = {r.trace: json.loads(r.payload) for r in got if r.event == "run_finished"}
    assert end["one"]["outcome"] == "success" and "-    return a + b  # BUG" in end["one"]["diff"] and end["two"]["outcome"] == "finished_without_tests"
    bad = agent.run_task({}, "t", "pytest -q", lambda s, p: "nothing")
    assert bad[-1]["payload"]["outcome"] == "invalid_json"


def test_policy(spark):
    got = {r.path: r.verdict for r in catalogue.QUERIES["write_policy"](spark, "").collect()}
    assert got["../x"] == got["a/../../b"] == got["/etc/passwd"] == "escapes" and got[".env"] == "protected" and got["node_modules/x.js"] == "internal" and got["a/../c.py"] == "allowed"
    f = spark.createDataFrame([("a b a", "a", "c"), ("a b", "a", "c"), ("b", "a", "c")], "t string, o string, n string")
    out = [r.r for r in f.select(policy.replace_once(f.t, f.o, f.n).alias("r")).collect()]
    assert [(r.ok, r.occurrences, r.content) for r in out] == [(False, 2, "a b a"), (True, 1, "c b"), (False, 0, "b")]
    args = spark.range(1).select(policy.container_command(catalogue.F.lit("/w"), catalogue.F.lit("pytest"), "img").alias("a")).first().a
    assert args[:3] == ["docker", "run", "--rm"] and args[-3:] == ["sh", "-lc", "pytest"] and "256" in args


def test_jsonl(spark, tmp_path):
    p = tmp_path / "runs/r1/trace.jsonl"
    p.parent.mkdir(parents=True)
    p.write_text('{"ts": 1.0, "event": "run_started", "payload": {"task": "t"}}\n\nbroken\n[1]\n{"ts": 2.0, "event": "run_finished", "payload": {"outcome": "success"}}\n')
    got = jsonl.read_traces(spark, str(tmp_path / "runs")).orderBy("seq").collect()
    assert [(r.seq, r.event) for r in got] == [(0, "run_started"), (4, "run_finished")] and got[1].payload.outcome == "success"
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "struct<a: int>").count() == 0
    with pytest.raises(Exception):
        jsonl.read_jsonl_strict(spark, str(p), "ts double").collect()
    out = str(tmp_path / "out")
    jsonl.write_jsonl(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string"), out, single_file=True)
    assert {r.record.a for r in jsonl.read_jsonl(spark, out, "struct<a: int>").collect()} == {1, 2}


def test_github_source(spark):
    class Fake(github.PullRequests):
        @classmethod
        def name(cls):
            return "fake_pulls"

        @staticmethod
        def get(url, accept=""):
            import json

            if url.endswith("&page=1"):
                return json.dumps([{"number": i, "title": "Fix", "diff_url": f"d{i}"} for i in range(1, 101)])
            return json.dumps([]) if "&page=" in url else ("" if url == "d3" else "diff --git a/x b/x")

    spark.dataSource.register(Fake)
    df = spark.read.format("fake_pulls").option("repo", "a/b").option("limit", 150).load()
    assert df.count() == 99 and df.rdd.getNumPartitions() == 2


def test_sources(spark):
    assert datasets.pick_split({"train": [{"a": 1}, 3]}, "test") == [{"a": 1}]
    with pytest.raises(ValueError):
        datasets.resolve(spark, "nowhere", {}, datasets.mbpp_seed(spark), datasets.MBPP)
    assert datasets.resolve(spark, "auto", {"hub": lambda s: []}, datasets.mbpp_seed(spark), datasets.MBPP).count() == 2


def test_stream(spark, tmp_path):
    from repairlake.streaming import traces as st

    for i in range(3):
        p = tmp_path / f"r{i}/trace.jsonl"
        p.parent.mkdir()
        p.write_text('{"ts": 1.0, "event": "run_finished", "payload": {"outcome": "success"}}\n')
    q = st.stream_outcomes(st.stream_events(spark, str(tmp_path / "*"))).writeStream.format("memory").queryName("outcomes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.outcome, r.runs) for r in spark.sql("SELECT * FROM outcomes").collect()] == [("success", 3)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

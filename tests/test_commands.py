import argparse
import json

from repairlake import cli
from repairlake.sources import github


def args(command, source, **more):
    base = {"base_url": None, "model": "", "limit": None, "bug_fix_only": False, "dry_run": False, "manifest": False}
    return argparse.Namespace(command=command, input=source, **(base | more))


def test_fetch_reads_linked_issues(spark, monkeypatch):
    class Fake(github.PullRequests):
        @staticmethod
        def get(url, accept=""):
            import json

            if "/pulls?" in url:
                titles = ["Fixes #7", "Update", "Closes #8", "Resolves #9"]
                return json.dumps([{"number": i, "title": t, "diff_url": f"d{i}"} for i, t in enumerate(titles, 1)])
            if url.endswith("/repos/a/b/issues/7"):
                return json.dumps({"title": "Crash on empty input", "body": "IndexError: regression"})
            if "/issues/" in url:
                return json.dumps({"title": "No body", "body": None}) if url.endswith("/8") else ""
            return "diff --git a/README.md b/README.md\n+x" if url == "d2" else "diff --git a/src/x.py b/src/x.py\n+x"

    monkeypatch.setattr(github, "PullRequests", Fake)
    got = {r.pr_number: r for r in cli.make(spark, args("fetch-github-prs", "a/b")).collect()}
    assert {n: (r.issue_number, r.issue_title, r.issue_body) for n, r in got.items()} == {1: (7, "Crash on empty input", "IndexError: regression"), 2: (None, "", ""), 3: (8, "No body", ""), 4: (9, "", "")}
    assert "linked issue" in got[1].bug_fix_reasons and any("regression" in x for x in got[1].bug_fix_reasons) and not got[2].is_bug_fix
    only = {r.pr_number for r in cli.make(spark, args("fetch-github-prs", "a/b", bug_fix_only=True)).collect()}
    assert 1 in only and 2 not in only


def test_run_manifest(spark, tmp_path):
    good = tmp_path / "repos/good"
    (good / "tests").mkdir(parents=True)
    (good / "calculator.py").write_text("def subtract(a, b):\n    return a + b  # BUG\n")
    (good / "tests/test_c.py").write_text("import unittest\nfrom calculator import subtract\n\n\nclass T(unittest.TestCase):\n    def test_s(self):\n        self.assertEqual(subtract(3, 1), 2)\n")
    (good / "data.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "repos/bare").mkdir()
    rows = [
        {"task": "no repo"}, {"repo": "repos/gone", "task": "t"}, {"repo": "repos/good", "task": "Fix subtract", "source": "mbpp", "id": "first", "extra": [1, {"a": None}]}, {"repo": "repos/good", "task": ""},
        {"repo": str(tmp_path / "repos/bare"), "task": "Other", "source": "unit_completion", "baseline_checked": True, "baseline_ok": False}, {"repo": "repos/good", "task": "beyond the limit"},
    ]
    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = tmp_path / "out"
    cli.jsonl.write_jsonl(cli.make(spark, args("run-manifest", str(manifest), limit=2)), str(out))
    got = [json.loads(x) for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()]
    assert [g["source"] for g in got] == rows[:5]
    r = [g["result"] for g in got]
    assert [(x["ok"], x["skipped"], x.get("reason"), x.get("outcome"), x.get("failure_attribution")) for x in r] == [
        (False, True, "missing repo or task", None, None), (False, True, "repo does not exist", None, None), (True, False, None, "success", "passed"),
        (False, True, "missing repo or task", None, None), (False, False, None, "finished_without_tests", "baseline_failure"),
    ]
    assert r[2]["steps"] == 6 and len(r[2]["events"]) == 9
    stats = {x.source: x for x in cli.make(spark, args("stats", str(out), manifest=True)).collect()}
    assert (stats["mbpp"].ran, stats["mbpp"].pass_rate, stats["unknown"].skipped) == (1, 1.0, 3)
    dry = [json.loads(x.j)["result"] for x in cli.make(spark, args("run-manifest", str(manifest), limit=1, dry_run=True)).selectExpr("to_json(struct(*)) AS j").collect()]
    assert [(x["ok"], x["skipped"]) for x in dry] == [(False, True), (False, True), (True, True), (False, True), (True, True), (True, True)]

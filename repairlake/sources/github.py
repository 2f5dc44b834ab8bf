"""Pull requests of a repository as a Python data source: one partition a page, fetched on executors.

    spark.dataSource.register(PullRequests)
    spark.read.format("pull_requests").option("repo", "owner/name").option("limit", 300).load()

Pages hold up to 100; those beyond the last are empty. Each request is tried three times: rate limits, server
errors and lost connections wait and try again, and if they last raise, so that Spark runs the task again and a
page is never taken for an empty one. What does not exist gives nothing. fetch, an option of the class, can be
replaced in tests. with_issues adds the issues that the pull requests close.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import linked_issue

API = "https://api.github.com"
RETRIED = (403, 429, 502, 503, 504)
PAGE = 100


def fetch(url: str, accept: str = "application/vnd.github+json", attempts: int = 3, wait: float = 2.0) -> str:
    """The body of a page; empty where there is none. Raises OSError where the last attempt fails for another reason."""
    headers = {"User-Agent": "repairlake", "Accept": accept}
    if token := os.environ.get("GITHUB_TOKEN"):
        headers["Authorization"] = f"Bearer {token}"
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED:
                return ""
            if attempt + 1 == attempts:
                raise
            reset = float(e.headers.get("X-RateLimit-Reset") or 0) - time.time()
            time.sleep(min(60.0, reset) if e.code in (403, 429) and reset > 0 else wait * (attempt + 1))
        except OSError:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * (attempt + 1))
    raise ValueError("no attempt was allowed")


def as_object(body: str):
    try:
        return json.loads(body)
    except ValueError:
        return {}


class Page(InputPartition):
    def __init__(self, number: int, rows: int):
        super().__init__(number)
        self.number, self.rows = number, rows


class PullRequests(DataSource):
    get = staticmethod(fetch)

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return "id string, repo string, pr_number bigint, pr_title string, pr_body string, pr_url string, diff string, files array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).get)


class _Reader(DataSourceReader):
    def __init__(self, options, get):
        self.repo, self.limit, self.state = options["repo"], int(options.get("limit", PAGE)), options.get("state", "closed")
        self.get = get

    def partitions(self):
        return [Page(i + 1, min(PAGE, self.limit - PAGE * i)) for i in range(-(-self.limit // PAGE))]

    def read(self, page: Page):
        found = as_object(self.get(f"{API}/repos/{self.repo}/pulls?state={self.state}&per_page={PAGE}&page={page.number}"))
        for pr in (found if isinstance(found, list) else [])[: page.rows]:
            number = pr.get("number")
            diff = self.get(pr.get("diff_url") or f"{API}/repos/{self.repo}/pulls/{number}", "application/vnd.github.v3.diff") if number else ""
            if number and diff:
                name = f"{self.repo.replace('/', '_')}_pr_{number}"
                yield (name, self.repo, number, pr.get("title") or "", pr.get("body") or "", pr.get("html_url") or "", diff, [])


def with_issues(pulls: DataFrame, get=fetch) -> DataFrame:
    """pulls with issue_number (null: no link), issue_title and issue_body of the issue in the same repository that
    each closes; both texts are empty where there is none or it can't be had. One pass, as pulls are fetched."""
    import pyarrow as pa

    linked = pulls.withColumn("issue_number", linked_issue("pr_title", "pr_body").cast("bigint"))

    def run(batches):
        known: dict[tuple, dict] = {}
        for batch in batches:
            issues = []
            for key in zip(batch.column("repo").to_pylist(), batch.column("issue_number").to_pylist(), strict=True):
                if key not in known:
                    try:
                        issue = as_object(get(f"{API}/repos/{key[0]}/issues/{key[1]}")) if key[1] else {}
                    except OSError:  # a record without its issue is still a record
                        issue = {}
                    known[key] = issue if isinstance(issue, dict) else {}
                issues.append(known[key])
            columns = [pa.array([i.get(c) or "" for i in issues], pa.string()) for c in ("title", "body")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "issue_title", "issue_body"])

    shape = ", ".join(f"`{c}` {t}" for c, t in linked.dtypes)
    return linked.mapInArrow(run, f"{shape}, issue_title string, issue_body string")

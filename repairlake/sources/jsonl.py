"""JSON lines in and out.

Lenient reading skips blank and malformed lines and takes a missing path for an empty table; strict reading
fails on the first bad line. Line order has a meaning in traces and manifests, and Spark's text scans do not
number lines, so that ordered reading takes each file whole and numbers its lines: fit for traces and task
lists. Larger record sets come without numbers.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_END


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """What a path or glob names, sorted; nothing where it names nothing. The file system is that of the path."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(c in pattern for c in "*?[]"):
        return [pattern] if fs.exists(path) else []
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def read_lines(spark: SparkSession, pattern: str, ordered: bool = False) -> DataFrame:
    """(path, seq, value) of non-blank lines; seq only where ordered, else null."""
    shape = "path string, seq bigint, value string"
    paths = _paths(spark, pattern)
    if not paths:
        return spark.createDataFrame([], shape)
    if ordered:
        whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", LINE_END, -1)).alias("seq", "value"))
        rows = whole.withColumn("seq", F.col("seq").cast("bigint"))
    else:
        rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("bigint").alias("seq"), "value")
    return rows.where(F.trim("value") != "")


def read_jsonl(spark: SparkSession, pattern: str, schema: str, ordered: bool = False) -> DataFrame:
    """(path, seq, record struct) of the lines that are JSON objects."""
    lines = read_lines(spark, pattern, ordered)
    parsed = lines.withColumn("_v", F.try_parse_json("value")).where(F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT"))
    return parsed.select("path", "seq", F.from_json("value", schema).alias("record"))


def read_jsonl_strict(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The records as columns; a bad line fails the query, a path of nothing gives an empty table."""
    paths = _paths(spark, pattern)
    return spark.read.json(paths, schema=schema, mode="FAILFAST") if paths else spark.createDataFrame([], schema)


def read_traces(spark: SparkSession, runs: str) -> DataFrame:
    """(trace, seq, ts, event, payload) of all runs/*/trace.jsonl, or of a single trace file."""
    from ..operators.traces import PAYLOAD

    pattern = runs if runs.endswith(".jsonl") else f"{runs.rstrip('/')}/*/trace.jsonl"
    # arguments are free JSON: read as the text they are
    got = read_lines(spark, pattern, ordered=True)
    parsed = got.withColumn("_v", F.try_parse_json("value")).where(F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT"))
    event = F.from_json("value", f"struct<ts: double, event: string, payload: {PAYLOAD}>")
    return parsed.select(F.col("path").alias("trace"), "seq", event.alias("e")).select("trace", "seq", "e.ts", "e.event", "e.payload")


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(text) of corpus records, stripped, without blank ones."""
    got = read_jsonl(spark, pattern, "struct<text: string>").select(F.trim("record.text").alias("text"))
    return got.where("text <> ''")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below a folder, paths relative to it, bytes that are no UTF-8 replaced."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return raw.select(F.regexp_replace("path", f"^.*?{_quoted(base.split(':')[-1])}/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c in "/_") else c for c in text)


def write_jsonl(rows: DataFrame, path: str, single_file: bool = False, keep_nulls: bool = False) -> None:
    """One JSON object a line. single_file is for small results that a reader wants in one part."""
    out = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false" if keep_nulls else "true"}).alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


#: Fixed value: the system prompt of chat-style samples.
SYSTEM_PROMPT = "You are a coding agent. Return exactly one safe JSON tool call for the next step."


def chat_rows(samples: DataFrame) -> DataFrame:
    """(system, instruction, input, output) of samples, inputs and outputs as pretty JSON."""
    pretty = lambda c: F.to_json(c, {"pretty": "true"})
    made = lambda c: pretty(c) if samples.schema[c].dataType.typeName() == "struct" else F.col(c)
    return samples.select(F.lit(SYSTEM_PROMPT).alias("system"), "instruction", made("input").alias("input"), made("output").alias("output"))


def write_chat_array(samples: DataFrame, path: str) -> None:
    """A single JSON array in one local file; rows stream through the driver one partition at a time."""
    import json

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(chat_rows(samples).toLocalIterator()):
            out.write(("," if i else "") + "\n  " + json.dumps(row.asDict(), ensure_ascii=False, indent=2).replace("\n", "\n  "))
        out.write("\n]" if out.tell() > 1 else "]")


def local_paths(pattern: str) -> list[str]:
    """Local files of a path, or of a glob where it holds one of *?[]; sorted."""
    return sorted(glob.glob(pattern)) if any(c in pattern for c in "*?[]") else [pattern]

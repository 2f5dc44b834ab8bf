"""Traces as a stream. A completed trace file is the unit: a file source lists each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_END
from ..operators.traces import PAYLOAD, true


def stream_events(spark: SparkSession, pattern: str) -> DataFrame:
    """(trace, seq, ts, event, payload) of trace files as they appear."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(pattern)
    lines = files.select(F.input_file_name().alias("trace"), F.posexplode(F.split("value", LINE_END, -1)).alias("seq", "value")).where(F.trim("value") != "")
    event = F.from_json("value", f"struct<ts: double, event: string, payload: {PAYLOAD}>")
    parsed = lines.withColumn("e", event).where("e.event is not null")
    return parsed.select("trace", F.col("seq").cast("bigint").alias("seq"), "e.ts", "e.event", "e.payload")


def stream_outcomes(events: DataFrame) -> DataFrame:
    """(outcome, runs) of finished runs so far (complete or update mode)."""
    done = events.where("event = 'run_finished'").select(F.coalesce(F.nullif("payload.outcome", F.lit("")), F.lit("missing_outcome")).alias("outcome"))
    return done.groupBy("outcome").agg(F.count("*").alias("runs"))


def stream_tool_rates(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, tool, calls, ok, violations) over event time, with a watermark for late files."""
    calls = events.where("event = 'tool_call'").withColumn("at", F.timestamp_seconds("ts"))
    return calls.withWatermark("at", late).groupBy(F.window("at", every), F.col("payload.tool").alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(true("payload.result.ok")).alias("ok"), F.count_if(true("payload.format_violation")).alias("violations"),
    )

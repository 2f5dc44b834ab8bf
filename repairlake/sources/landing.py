"""Landing a table between two long projections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="repairlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def landed(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Cards are landed before exports: several exports read them, and
    planning one projection of both takes far longer than running the two."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/landed/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

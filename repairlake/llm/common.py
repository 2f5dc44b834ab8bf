"""Shared helpers of the training-data operators.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D. All of those
separators are single UTF-8 bytes, so ``bytes.split()`` without arguments cuts exactly there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    (local tests) a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="repairlake-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back. It cuts the lineage, so that a
    lost executor costs only the tasks it ran, and keeps what several later jobs read from being made twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/staged/" in path:
                where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


AT_MOST = 8 << 20
BITMAP_BITS = 24


def slices(batch: pa.RecordBatch, at_once: int, at_most: int = AT_MOST) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most at_once rows, whose texts and binaries together have at most at_most bytes (or one row)."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(size), 0
    while begin < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_most, "right"))
        stop = min(begin + at_once, max(full, begin + 1))
        yield batch.slice(begin, stop - begin)
        begin = stop


def arrow_map(df: DataFrame, rows: Callable, schema: str, start: Callable | None = None, at_once: int = 1000) -> DataFrame:
    """mapInArrow over slices() of the batches as lists of Python values: ``rows`` turns columns into columns of any
    length, or yields several such. ``start()``, once a task, returns what ``rows`` gets as its second argument."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            for part in slices(batch, at_once):
                got = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                made = rows(got, state) if start else rows(got)
                for one in (made,) if isinstance(made, dict) else made:
                    yield pa.RecordBatch.from_arrays([pa.array(one[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def split_by(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among keys, and those that are not, by a bitmap of 2^24 places over (doc_id, th). It is
    broadcast as at most 2^18 words of 64 bits."""
    place = F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << BITMAP_BITS))
    at = keys.select(place.alias("p")).distinct().select((F.col("p") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    bits = F.broadcast(staged(at.groupBy("_word").agg(F.bit_or("b").alias("_bits")), "bitmap"))
    put = docs.withColumn("_place", place)
    on = (F.floor(F.col("_place") / 64).cast("int") == F.col("_word")) & (F.expr("shiftright(_bits, cast(_place % 64 as int)) & 1") == 1)
    return tuple(put.join(bits, on, how).drop("_place") for how in ("left_semi", "left_anti"))


def n_words(text) -> F.Column:
    """Words of a text as a JVM expression, long; null or empty: 0. Words become one letter each, blanks go."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(squeezed, SPACES, "")).cast("long")

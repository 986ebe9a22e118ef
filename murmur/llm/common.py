"""What the training-data operators share: bounded Arrow batches, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes that one Arrow batch carries to a Python worker (a single longer text makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; smaller settings of the session stay. Plans read these settings when
    they run, which is after an operator has returned, so they stay set for the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="murmur-")]
        at = _own[0]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, outlives executors, is computed once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/murmur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def utf8(column: str = "text") -> Column:
    """A text as its UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def free(df: DataFrame) -> str:
    """A prefix that no column of df begins with."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def remainder(column: str, by: int) -> Column:
    """crc32 of the id written as text, modulo by (null ids count as 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(0)).cast("int")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(items: Iterator, weigh, most: int) -> Iterator[list]:
    """Items in lists of at most so much weight (one heavier item is a list of its own)."""
    held, weight = [], 0
    for x in items:
        w = weigh(x)
        if held and weight + w > most:
            yield held
            held, weight = [], 0
        held.append(x)
        weight += w
    if held:
        yield held

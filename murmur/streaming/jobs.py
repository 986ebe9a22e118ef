"""Resumable work as Structured Streaming: new files become micro-batches, checkpoints remember them, batches overwrite
their own folder, so that a repeated one leaves the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window; late rows up to the watermark count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("segments"), F.sum("value").alias("total"))


def resume(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> int:
    """Work on whatever files of source are new since the last call; the number of micro-batches that it took."""
    done = []

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    spark.readStream.schema(schema).format(fmt).load(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


STATUS = "job string, updated_at long, status string"


def append_status(rows: DataFrame, table: str) -> None:
    """Statuses (job, updated_at, status) appended to the job table."""
    rows.select("job", "updated_at", "status").write.mode("append").parquet(table)


def latest_status(spark: SparkSession, table: str) -> DataFrame:
    """The last status of each job, whichever run of the program wrote it."""
    rows = spark.read.schema(STATUS).parquet(table)
    return rows.groupBy("job").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"), F.max("updated_at").alias("updated_at"))


def progress(query) -> dict:
    """How far a running query is: batches, rows so far, whether it is active, and its error."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "active": query.isActive, "error": None if query.exception() is None else str(query.exception())}


#: The state store that keyed state needs; a query keeps the one that its checkpoint names.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kept_items(stream: DataFrame, group: str, rule: str, ttl_seconds: int | None = None) -> DataFrame:
    """Greedy fuzzy dedup of a stream of (group, pos, text): (group, pos, text) of items that no kept one of their group
    resembles, as they come in.

    Later batches are held against the kept texts of their group (kept.Kept); items of one batch go in the order of pos. A
    rule that replaces kept items keeps the first one here, since rows that are out cannot be taken back. With a time
    to live, pages of kept texts that gained nothing for so long are forgotten. Null texts are left out. The session's state
    store for new queries becomes RocksDB.
    """
    from murmur.streaming.kept import Kept

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema[group].dataType.simpleString()
    x = stream.select(F.col(group).alias("group"), F.col("pos").cast("long"), "text").groupBy("group")
    ttl, mode = (None, "none") if ttl_seconds is None else (1000 * ttl_seconds, "processingTime")
    return x.transformWithStateInPandas(Kept(rule, ttl), f"group {kind}, pos long, text string", "append", mode).withColumnRenamed("group", group)


def first_seen(stream: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Exact dedup on a stream: the first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

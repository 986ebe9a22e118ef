"""The job table of streaming queries: a listener appends what each query reports, and a view says how every job stands."""

from __future__ import annotations

import datetime
import hashlib
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from murmur.sources.pcm import located

EVENT = pa.schema([("job", pa.string()), ("updated_at", pa.int64()), ("status", pa.string()), ("batch", pa.int64()), ("rows", pa.int64()), ("message", pa.string())])
COLUMNS = "job string, updated_at long, status string, batch long, rows long, message string"


class JobListener(StreamingQueryListener):
    """Appends a small file for each batch and for the end of each query to the table's folder.

    A file is named by job and batch and becomes visible by one rename, so that an event that is told twice, or a batch
    that runs again after a failure, is one row. Jobs are the queries' names (their ids where they have none), which
    restarts share. An error while writing is raised in the listener alone; the query goes on.
    """

    def __init__(self, table: str) -> None:
        self.table, self.names = table, {}

    def _put(self, of: str, job: str, at: int, status: str, batch: int | None, rows: int | None, message: str | None) -> None:
        files, folder = located(self.table)
        files.create_dir(folder, recursive=True)
        hidden, name = f"{folder}/_{uuid.uuid4().hex}", hashlib.sha256(f"{len(job)}:{job}{of}".encode()).hexdigest()
        pq.write_table(pa.table([[job], [at], [status], [batch], [rows], [message]], schema=EVENT), hidden, filesystem=files)
        files.move(hidden, f"{folder}/{name}.parquet")

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        job = self.names[event.runId] = event.name or str(event.id)
        self._put(f"start:{event.runId}", job, _millis(event.timestamp), "running", None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        job = self.names[p.runId] = p.name or str(p.id)
        if p.numInputRows:
            self._put(f"batch:{p.batchId}", job, _millis(p.timestamp), "running", p.batchId, p.numInputRows, None)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        wrong = event.exception
        self._put(f"end:{event.runId}", self.names.pop(event.runId, str(event.id)), int(time.time() * 1000), "done" if wrong is None else "failed", None, None, wrong)


def _millis(stamp: str) -> int:
    return int(datetime.datetime.fromisoformat(stamp).timestamp() * 1000)


def board(spark: SparkSession, table: str, now: int | None = None, stale: int | None = None) -> DataFrame:
    """(job, status, updated_at, batches, rows, message): how each job stands, from all events, whichever program wrote them.

    A job goes by its last event, an end before others of the same millisecond; one that has been running without a word for
    more than `stale` milliseconds before `now` (its program is gone) is interrupted. Rows written by jobs.append_status count too.
    """
    now = int(time.time() * 1000) if now is None else now
    x = spark.read.schema(COLUMNS).parquet(table)
    order = F.struct("updated_at", F.col("status") != "running", F.coalesce("batch", F.lit(-1)), "status")
    x = x.groupBy("job").agg(F.max_by(F.struct("status", "message"), order).alias("last"), F.max("updated_at").alias("updated_at"), F.count_distinct("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    gone = (F.col("last.status") == "running") & (F.lit(now) - F.col("updated_at") > F.lit(stale))
    status = F.col("last.status") if stale is None else F.when(gone, "interrupted").otherwise(F.col("last.status"))
    return x.select("job", status.alias("status"), "updated_at", "batches", "rows", F.col("last.message").alias("message"))

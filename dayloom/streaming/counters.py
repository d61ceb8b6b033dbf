"""Counters of what each micro-batch read, accepted and passed over.

The counts are taken inside the streaming plan (``observe``), so the input is read once, and stored below the store's
folder, one row per batch: a batch that is repeated after a failure overwrites its row and counts once. They are
written after the batch's commit: where the driver is lost in between, the row of that one batch is missing.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from dayloom.session import path_exists

_COUNTS = "_counts"
SCHEMA = "n_read bigint, n_accepted bigint, n_null_key bigint, n_late bigint"


def observed(stream: DataFrame, ts: str, keys: Sequence[str], name: str = "input") -> DataFrame:
    """The same rows, counted under ``name``: all of them, and those without a time or a key."""
    missing = F.col(ts).isNull()
    for k in keys:
        missing = missing | F.col(k).isNull()
    return stream.observe(name, F.count(F.lit(1)).alias("n_read"), F.count_if(missing).alias("n_null_key"))


class _Listener(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.ended: set[str] = set()
        self.error: Exception | None = None
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(self.name)
        if counts is None:
            return
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        row = (counts["n_read"], counts["n_read"] - counts["n_null_key"], counts["n_null_key"], late)
        try:
            frame = self.spark.createDataFrame([row], SCHEMA).coalesce(1)
            frame.write.mode("overwrite").parquet(f"{self.path}/{_COUNTS}={progress.batchId}")
        except Exception as error:  # an error in a listener reaches nobody: keep it for finish
            self.error = self.error or error

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def finish(self, query: StreamingQuery, timeout: float = 120.0) -> None:
        """Wait for the query's end and until the counts of all its batches are stored."""
        query.awaitTermination()
        with self.changed:
            if not self.changed.wait_for(lambda: str(query.runId) in self.ended, timeout):
                raise TimeoutError("the counters of a stream did not arrive")
        if self.error:
            raise RuntimeError("the counters of a batch were not stored") from self.error


@contextmanager
def counting(spark: SparkSession, path: str, name: str = "input") -> Iterator[_Listener]:
    """Store the counts that streams observe under ``name`` below ``path`` while the block runs."""
    listener = _Listener(spark, path, name)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: ``batch``, ``n_read``, ``n_accepted``, ``n_null_key`` and ``n_late``.

    ``n_late`` is what the watermark dropped: rows, or groups where the plan sums up before the state. Late ones are
    among the accepted. Empty where nothing was counted.
    """
    if not path_exists(spark, f"{path}/{_COUNTS}=*"):
        return spark.createDataFrame([], f"batch bigint, {SCHEMA}")
    stored = spark.read.option("basePath", path).parquet(f"{path}/{_COUNTS}=*")
    return stored.select(F.col(_COUNTS).cast("bigint").alias("batch"), "n_read", "n_accepted", "n_null_key", "n_late")

"""Where streams end: tables keyed by run and batch, and a log of their progress."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The store that keyed state with timers needs.
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BatchTable:
    """A Parquet table of what the batches of a run wrote. A batch that runs again replaces what it wrote before, so repeating changes nothing."""

    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def write(self, rows: DataFrame, number: int) -> None:
        # chunks of one text overlap farther apart than the usual codec sees
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/run={self.run}/batch={number}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows of all runs, with ``run`` and ``batch``; none if nothing was written yet, or all was dropped."""
        schema = f"{schema}, run string, batch long"
        files, at = self._folder(spark)
        return spark.read.schema(schema).parquet(self.path) if files.exists(at) else spark.createDataFrame([], schema)

    def _folder(self, spark: SparkSession):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, spark: SparkSession) -> None:
        """Delete all batches."""
        drop_batches(spark, self)


def drop_batches(spark: SparkSession, *tables: BatchTable) -> None:
    """Delete all batches of these tables, older ones first: if the driver stops midway, what is left of a key is what was written last."""
    pattern, found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for held in tables:
        files, at = held._folder(spark)
        found += [(int(x.getPath().getName().split("=")[1]), files, x.getPath()) for x in files.globStatus(pattern(at, "run=*/batch=*")) or []]
    for _, files, at in [*sorted(found, key=lambda x: x[0]), *((0, *held._folder(spark)) for held in tables)]:
        files.delete(at, True)


def last_written(rows: DataFrame, *keys: str, order: tuple[str, ...] = ("batch",)) -> DataFrame:
    """The row of each key that was written last; of several, the greatest by what else they hold. An aggregation: partial ones run before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    # one struct, so that no column is shuffled twice
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last"))
    return last.select(*keys, *[f"_last.{c}" for c in rest])


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started in this block keep their state in the store that timers and lists need; the session's own setting comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What statements in this block shuffle leaves the disks when each ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_DROPPED, None)
    spark.conf.set(SHUFFLES_DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_DROPPED, before) if before else spark.conf.unset(SHUFFLES_DROPPED)


def run_batches(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``into(batch, number)`` for what has arrived and wait for the end; a later call goes on from the checkpoint."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


PROGRESS = (
    "event string, ts string, input_rows long, rows_per_second double, duration_ms long, state_rows long, dropped_late long, watermark string, message string"
)


class ProgressLog(StreamingQueryListener):
    """Writes each start, batch and end of the streams of a session as one JSON file by run and batch, in a folder that all share.

    A run is a stream's checkpoint, so a restart goes on with it; a batch that runs again replaces its row. Use it as a context: it
    listens as long as that lasts, and ``wait`` returns when the end of a stream was written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _end_of(self, start: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(start, threading.Event())

    def _put(self, run: str, batch: int, name: str, **row) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={run}/batch={batch}/{name}.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(json.dumps({"event": name} | row).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self._put(str(event.id), -1, "init", ts=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = p.stateOperators
        self._put(
            str(p.id), p.batchId, "progress", ts=p.timestamp, input_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, duration_ms=p.batchDuration,
            state_rows=sum(s.numRowsTotal for s in states), dropped_late=sum(s.numRowsDroppedByWatermark for s in states), watermark=p.eventTime.get("watermark"),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(str(event.id), -1, "finish" if event.exception is None else "error", message=event.exception)
        self._end_of(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of stream {query.id} in {seconds} s")

    def read(self) -> DataFrame:
        """Rows by ``run`` and ``batch`` (-1: the run itself)."""
        return self.spark.read.schema(f"{PROGRESS}, run string, batch long").json(self.path)

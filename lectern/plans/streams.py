"""Streams over the test tables: arrivals, step states, histories and progress, each in several batches with one repeated."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators.index import ChunkIndex
from lectern.streaming import arrivals as A
from lectern.streaming import sinks as K
from lectern.streaming import state as S

from .library import ORACLES as LIBRARY
from .library import events_parsed
from .observe import _interactions
from .tables import documents, shared_folder, table

BATCHES = 3


def _in_batches(spark, rows, name: str, by, run):
    """Rows arrive in a folder in ``BATCHES`` parts, by a number; ``run(stream)`` is called after each. Files of a part that is done are not kept."""
    folder = shared_folder(spark, name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in range(BATCHES):
        rows.where(by == n).write.mode("append").option("compression", "zstd").parquet(folder)
        run(A.arriving(spark, folder, rows.schema))
        files.delete(at, True)


def arriving_documents(spark, sf_dir):
    """Documents that arrive in three batches, those of the first also in an older form before, one batch repeated; folded into an index and read back.
    One that has no text in the end has no chunks, whatever its older form had."""
    d = documents(spark, sf_dir).select("doc_id", "text", "source")
    part = F.pmod(F.col("doc_id"), F.lit(BATCHES))
    old = d.where(part > 0).select("doc_id", F.concat(F.lit("old and longer\n\n"), F.repeat("text", F.lit(2))).alias("text"), "source")
    rows = d.withColumn("n", part).unionByName(old.withColumn("n", F.lit(0)))
    arrivals = A.Arrivals(spark, shared_folder(spark, "arrivals"), "plain", emptied=True)
    _in_batches(spark, rows, "inbox", F.col("n"), arrivals.run)
    arrivals.write(d.where(part == BATCHES - 1), BATCHES - 1)
    index = ChunkIndex(spark, shared_folder(spark, "index"))
    index.create()
    index.upsert(arrivals.rows().where("doc_id like '%7'").withColumn("content", F.lit("before")))
    arrivals.fold(index)
    return index.scan().select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_id", "chunk_index", "content", F.size("embedding").alias("dims"))


def _step_events(spark, sf_dir):
    """The events that ``stage_states`` sees, dealt to batches without regard to their order."""


    e = events_parsed(spark, sf_dir).where(F.col("seq") < F.col("query_id") % 9).withColumn("error", F.lit(None).cast("string"))
    failed = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(
        F.col("item_id").alias("query_id"), F.lit(99).alias("seq"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("status"), F.lit("x").alias("error")
    )
    return e.unionByName(failed).withColumn("n", F.pmod(F.xxhash64("query_id", "seq"), F.lit(BATCHES)))


def stream_stage_states(spark, sf_dir):
    """States of steps kept by key over a stream of their events in any order."""
    out = shared_folder(spark, "steps")
    held = K.BatchTable(f"{out}/changes", "steps")
    run = lambda stream: K.run_batches(S.stream_states(stream), held.write, f"{out}/checkpoint", "update")
    _in_batches(spark, _step_events(spark, sf_dir), "events", F.col("n"), run)
    return K.last_written(held.read(spark, S.STEPS), "query_id", "stage", order=("version",)).select("query_id", "stage", "status")


def stream_recent(spark, sf_dir):
    """The mean of each session's last ten response times, from a state of its last twenty entries, after events in any order."""
    out = shared_folder(spark, "history")
    held = K.BatchTable(f"{out}/rows", "history")
    e = _interactions(spark, sf_dir).select("session_id", "ts", "event_id", "response_time")
    run = lambda stream: K.run_batches(S.stream_history(stream), held.write, f"{out}/checkpoint", "update")
    _in_batches(spark, e, "events", F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)), run)
    last = K.last_written(held.read(spark, S.HISTORY), "session_id", order=("version",))
    return last.select("session_id", "entries", "last_event", F.round("recent", 6).alias("recent"))


def stream_progress(spark, sf_dir):
    """What the log of a stream of three batches tells of each, beside what its sink holds after one batch was repeated."""
    out = shared_folder(spark, "progress")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"))
    held = K.BatchTable(f"{out}/metrics", "metrics")
    by_type = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    log = K.ProgressLog(spark, f"{out}/log")
    part = F.pmod(F.col("event_id"), F.lit(BATCHES))

    def run(stream):
        log.wait(K.run_batches(stream, lambda rows, n: held.write(by_type(rows), n), f"{out}/checkpoint"))

    with log:
        _in_batches(spark, e, "events", part, run)
    held.write(by_type(e.where(part == 1)), 1)
    told = log.read().where("event = 'progress'").select("batch", "input_rows")
    kept = held.read(spark, "event_type string, n long").groupBy("batch").agg(F.sum("n").alias("kept_rows"), F.count("*").alias("kinds"))
    return told.join(kept, "batch").select("batch", "input_rows", "kept_rows", "kinds")


QUERIES = {f.__name__: f for f in (arriving_documents, stream_stage_states, stream_recent, stream_progress)}
ORACLES = {
    "arriving_documents": f"SELECT doc_id, chunk_id, chunk_index, content, dims FROM ({LIBRARY['ingest_documents']})",
    "stream_stage_states": LIBRARY["stage_states"],
    "stream_recent": f"""SELECT session_id, least(20, count(*)) AS entries, arg_max(event_id, (ts, event_id)) AS last_event, round(arg_max(recent, (ts, event_id)), 6) AS recent
 FROM (SELECT *, avg(response_time) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS recent
  FROM (SELECT user_id AS session_id, value AS response_time, ts, event_id FROM events)) GROUP BY session_id""",
    "stream_progress": f"""SELECT event_id % {BATCHES} AS batch, count(*) AS input_rows, count(*) AS kept_rows, count(DISTINCT event_type) AS kinds
 FROM events GROUP BY ALL""",
}

"""Events of running questions, answer tokens and periodic metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import col

STAGES = ("search", "ranking", "context", "answer")
EVENT = "stage string, status string, token string, error string"


def stage_events(requests: DataFrame, by: str = "query_id") -> DataFrame:
    """For each request the events of its stages in order, as server-sent lines."""
    steps = [(s, status) for s in STAGES for status in ("in_progress", "done")]
    events = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(status).alias("status")) for s, status in steps])
    rows = requests.select(by, F.posexplode(events).alias("seq", "event"))
    return rows.select(by, "seq", F.concat(F.lit("data: "), F.to_json("event"), F.lit("\n\n")).alias("line"))


def parse_events(text) -> Column:
    """Events in a piece of a stream: blocks cut at blank lines, ``data: `` lines parsed, the end mark left out."""
    blocks = F.filter(F.split(col(text), "\n\n"), lambda b: F.startswith(b, F.lit("data: ")) & (b != "data: [DONE]"))
    return F.transform(blocks, lambda b: F.from_json(F.substring(b, F.lit(7), F.length(b)), EVENT))


def stage_states(events: DataFrame, by: str = "query_id", seq: str = "seq") -> DataFrame:
    """The last status of each stage; the stage after one that is done and has none yet is in progress; an error event
    makes stages in progress failed."""
    last = events.where("stage is not null").groupBy(by, "stage").agg(F.max_by("status", seq).alias("status"), F.max(seq).alias("seq"))
    after = F.create_map(*[F.lit(x) for pair in zip(STAGES, STAGES[1:]) for x in pair])
    due = last.where("status = 'done'").select(by, after[F.col("stage")].alias("stage"), F.lit("in_progress").alias("status"), "seq").where("stage is not null")
    last = last.unionByName(due.join(last.select(by, "stage"), [by, "stage"], "left_anti"))
    failed = events.groupBy(by).agg(F.max(F.when(F.col("error").isNotNull(), F.col(seq))).alias("_failed"))
    error = F.col("_failed").isNotNull() & (F.col("status") == "in_progress")
    return last.join(failed, by).select(by, "stage", F.when(error, "error").otherwise(F.col("status")).alias("status"))


def gather_tokens(tokens: DataFrame, by: str = "message_id", seq: str = "seq") -> DataFrame:
    """Messages from their tokens, in order."""
    rows = F.sort_array(F.collect_list(F.struct(seq, "token")))
    return tokens.groupBy(by).agg(F.array_join(F.transform(rows, lambda t: t["token"]), "").alias("content"))


def windowed_metrics(events: DataFrame, width: str = "2 seconds", late: str = "10 seconds", ts: str = "ts", value: str = "value", kind: str = "event_type") -> DataFrame:
    """Tumbling windows of event time: count, mean value and errors. Works on streams and tables."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, width).alias("window")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.count_if(F.col(kind) == "error").alias("errors")
    )


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(by, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))

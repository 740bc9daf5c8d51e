"""Logs of runs, metrics, errors and interactions: rows that are appended to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import error_kind

EVENT = ("session_id", "seq", "event", "payload")


def metric_events(metrics: DataFrame, session: str, order: str, *names: str) -> DataFrame:
    """One event for each row of metrics, its values as JSON; null values are left out."""
    return metrics.select(
        F.col(session).cast("string").alias("session_id"), F.col(order).cast("long").alias("seq"), F.lit("metrics").alias("event"),
        F.to_json(F.struct(*names)).alias("payload"),
    )


def error_events(errors: DataFrame, session: str, order: str, name: str, message: str, context: str | None = None) -> DataFrame:
    """One event for each error: its message, name, kind and context as JSON."""
    fields = [F.col(message).alias("error_message"), F.col(name).alias("error_name"), error_kind(message).alias("error_kind")]
    fields += [F.col(context).alias("context")] if context else []
    return errors.select(
        F.col(session).cast("string").alias("session_id"), F.col(order).cast("long").alias("seq"), F.lit("error").alias("event"),
        F.to_json(F.struct(*fields)).alias("payload"),
    )


def run_events(sessions: DataFrame, session: str, order: str) -> DataFrame:
    """The start and the end of each session's run, before and after its other events."""
    runs = sessions.groupBy(F.col(session).cast("string").alias("session_id")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    start = runs.select("session_id", (F.col("first") - 1).cast("long").alias("seq"), F.lit("init").alias("event"), F.lit("{}").alias("payload"))
    end = runs.select("session_id", (F.col("last") + 1).cast("long").alias("seq"), F.lit("finish").alias("event"), F.lit("{}").alias("payload"))
    return start.unionByName(end)


def append(events: DataFrame, path: str) -> None:
    """Add events to the log in a folder that all executors share."""
    events.select(*EVENT).write.mode("append").parquet(path)


def read_log(spark, path: str, event: str | None = None) -> DataFrame:
    rows = spark.read.schema("session_id string, seq long, event string, payload string").parquet(path)
    return rows.where(F.col("event") == event) if event else rows


def clear(spark, path: str) -> None:
    """An empty log in the place of the old one."""
    spark.createDataFrame([], "session_id string, seq long, event string, payload string").write.mode("overwrite").parquet(path)

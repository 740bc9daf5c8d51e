"""Statistics of documents, sessions, messages and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import col, confidence_share, total


def library_status(docs: DataFrame) -> DataFrame:
    """Documents, chunks and embeddings in all; from array columns ``chunks`` and ``embeddings``."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c))), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("documents"), n("chunks").alias("chunks"), n("embeddings").alias("embeddings"))


def document_diagnostics(docs: DataFrame, content: str = "content") -> DataFrame:
    """Counts, whether chunks and embeddings pair up, a preview and the dimension, for each document."""
    sound = F.coalesce((F.size("chunks") == F.size("embeddings")) & (F.size("chunks") > 0), F.lit(False))
    return docs.select(
        "doc_id", F.size("chunks").alias("n_chunks"), F.size("embeddings").alias("n_embeddings"), sound.alias("sound"),
        F.concat(F.substring(content, 1, 100), F.lit("...")).alias("preview"),
        F.coalesce(F.size(F.get("embeddings", F.lit(0))), F.lit(0)).alias("dimension"),
    )


def ingestion_metrics(chunks: DataFrame) -> DataFrame:
    """Chunk count, total and mean length for each document."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("content")).alias("chunk_chars"), F.avg(F.length("content")).alias("avg_chunk_length")
    )


def library_totals(docs: DataFrame) -> DataFrame:
    """Chunks, bytes (the first size given that isn't 0) and mean confidence in percent."""
    size = F.coalesce(F.nullif("size", F.lit(0)), F.nullif("file_size", F.lit(0)), F.nullif(F.length("content"), F.lit(0)), F.length(F.array_join("chunks", "")), F.lit(0))
    return docs.agg(
        F.sum(F.size("chunks")).alias("total_chunks"), F.sum(size).cast("long").alias("total_size"),
        F.floor(F.avg(confidence_share("confidence")) * 100 + 0.5).cast("long").alias("mean_confidence"),
    )


def session_metrics(interactions: DataFrame) -> DataFrame:
    """Queries, mean response time and relevance, and duration of each session."""
    return interactions.groupBy("session_id").agg(
        F.count("*").alias("queries"), F.avg("response_time").alias("avg_response_time"), F.avg("relevance").alias("avg_relevance"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"),
    )


def in_blocks(rows: DataFrame, by: str, order, block: str, **sums: str) -> DataFrame:
    """``rows`` with ``_block``, a span of time, and what the earlier blocks of their key held: ``_before`` rows, and the sums asked for.

    Only totals of blocks are put in order by key, so a key that holds a third of all rows is as many tasks as it has blocks. The
    first column of ``order`` is a time.
    """
    start = F.window(F.col(order[0]).cast("timestamp"), block)["start"]
    placed = rows.withColumn("_block", start)
    totals = placed.groupBy(by, "_block").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    earlier = W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    carried = totals.select(F.col(by).alias("_key"), F.col("_block").alias("_at"), so_far("_n").alias("_before"), *[so_far(f"_sum_{n}").alias(f"_before_{n}") for n in sums])
    same = placed[by].eqNullSafe(carried["_key"]) & placed["_block"].eqNullSafe(carried["_at"])
    return placed.join(carried, same).drop("_key", "_at")


def running_metrics(interactions: DataFrame, ties=("ts",), block: str = "1 day") -> DataFrame:
    """Session metrics after each interaction; sessions are summed by blocks of time, so a long one is many tasks."""
    given = interactions.withColumn("_given", F.col("response_time").isNotNull().cast("long"))
    placed = in_blocks(given, "session_id", ties, block, time="response_time", given="_given")
    so_far = W.partitionBy("session_id", "_block").orderBy(*ties).rowsBetween(W.unboundedPreceding, 0)
    n = F.col("_before_given") + F.sum("_given").over(so_far)
    total_time = F.col("_before_time") + F.coalesce(F.sum("response_time").over(so_far), F.lit(0))
    return placed.select(
        *interactions.columns, (F.col("_before") + F.count("*").over(so_far)).alias("queries_so_far"), (total_time / F.nullif(n, F.lit(0))).alias("avg_response_so_far")
    )


def interaction_metrics(interactions: DataFrame) -> DataFrame:
    return interactions.select(
        "*", F.length("query").alias("query_length"), F.length("response").alias("response_length"), F.size("sources").alias("source_count")
    )


def message_metrics(messages: DataFrame, text: str = "content", failed: str = "error") -> DataFrame:
    """User queries, mean response time of answers that have one, error and success rates in percent."""
    answered = F.when((F.col("role") == "assistant") & (F.col("response_time") != 0), F.col("response_time"))
    errors = F.count_if(F.coalesce(F.contains(F.col(text), F.lit(failed)), F.lit(False)))
    rate = F.when(F.count("*") > 0, errors / F.count("*") * 100).otherwise(0.0)
    one = lambda x: F.floor(x * 10 + 0.5) / 10
    return messages.agg(
        F.count_if(F.col("role") == "user").alias("total_queries"),
        F.coalesce(F.floor(F.avg(answered) + 0.5), F.lit(0)).cast("long").alias("avg_response_time"),
        one(rate).alias("error_rate"), one(100 - rate).alias("success_rate"),
    )


# What each measure above its bounds costs of a score of 100.
DEDUCTIONS = {
    "memory": ((80, 20), (60, 10)),
    "cpu": ((80, 15), (60, 8)),
    "response": ((2000, 15), (1000, 8)),
    "latency": ((500, 10), (200, 5)),
    "errors": ((10, 20), (5, 10)),
}


def performance_score(memory, cpu, response, latency, errors) -> Column:
    given = {"memory": memory, "cpu": cpu, "response": response, "latency": latency, "errors": errors}
    lost = [
        F.when(col(given[name]) > high, cost).when(col(given[name]) > low, less).otherwise(0)
        for name, ((high, cost), (low, less)) in DEDUCTIONS.items()
    ]
    return F.greatest(F.lit(0), F.lit(100) - total(lost))


def health_score(model_ready, documents, has_key, engine_ok, performance) -> Column:
    points = [(col(model_ready), 25), (col(documents) > 0, 20), (col(has_key), 15), (col(engine_ok), 15), (col(performance) > 80, 25)]
    return F.least(F.lit(100), total([F.when(c, n).otherwise(0) for c, n in points]))


def memory_estimate(documents, messages, history, extra=0) -> Column:
    return F.least(F.lit(100.0), col(documents) * 10 + col(messages) * 2 + col(history) * 0.1 + extra)


def cpu_estimate(history: DataFrame, duration: str, by: str, order: list[str], last: int = 10) -> DataFrame:
    """``cpu``: the mean of the last durations up to each row, 100 at most."""
    recent = sliding_means(history, [duration], by, order, last)
    return recent.withColumn("cpu", F.least(F.lit(100.0), F.col(f"recent_{duration}"))).drop(f"recent_{duration}")


# Activity levels and the load each stands for.
ACTIVITY = {"processing": 80, "querying": 30, "active": 20, "idle": 10}


def activity_load(activity, extra=0) -> Column:
    """The load an activity stands for, where nothing was measured."""
    a = col(activity)
    return F.coalesce(*[F.when(a == name, load) for name, load in ACTIVITY.items()], F.lit(ACTIVITY["idle"])) + extra


def diagnostic_report(docs: DataFrame) -> DataFrame:
    """``report``: one line for each document with chunks, vectors and whether they pair up, for ``document_diagnostics`` rows."""
    state = F.when(F.col("sound"), "ok").otherwise("broken")
    line = F.concat_ws(" ", F.concat(F.col("doc_id").cast("string"), F.lit(":")), F.col("n_chunks").cast("string"), F.lit("chunks,"), F.col("n_embeddings").cast("string"), F.lit("vectors,"), state)
    return docs.select("doc_id", line.alias("report"))


#: Rows of a key that are averaged in one task.
TILE = 8_192


def engine_state(initialized, model_ready, documents) -> Column:
    """Whether questions can be asked, and if not, what is missing first."""
    return F.when(~col(initialized), "not initialized").when(~col(model_ready), "no model").when(col(documents) == 0, "no documents").otherwise("ready")


def system_report(status: DataFrame, diagnostics: DataFrame, provider: str | None, model: str | None, state: Column | None = None) -> DataFrame:
    """The report on a library as rows of Markdown, ``section``, ``nth``, ``text``: totals, then one row for each document, so no row holds them all.

    ``status`` is of ``library_status``, ``diagnostics`` of ``document_diagnostics``.
    """
    line = lambda name, value: F.concat(F.lit(f"- **{name}:** "), value.cast("string"), F.lit("\n"))
    totals = status.select(
        F.lit("status").alias("section"), F.lit(0).cast("long").alias("nth"),
        F.concat(
            line("State", state if state is not None else engine_state(F.lit(True), F.lit(model is not None), "documents")),
            line("Provider", F.lit(provider or "Not Set")), line("Model", F.lit(model or "Not Set")), line("Documents", F.col("documents")),
            line("Total Chunks", F.col("chunks")), line("Total Embeddings", F.col("embeddings")),
        ).alias("text"),
    )
    of_document = diagnostics.select(
        F.lit("document").alias("section"), F.col("doc_id").cast("long").alias("nth"),
        F.concat(
            line("Chunks", F.col("n_chunks")), line("Embeddings", F.col("n_embeddings")), line("Valid Structure", F.when(F.col("sound"), "yes").otherwise("no")),
            line("Embedding Dimension", F.col("dimension")), line("Preview", F.col("preview")),
        ).alias("text"),
    )
    return totals.unionByName(of_document)


def sliding_means(history: DataFrame, values: list[str], by: str, order: list[str], last: int = 10, block: str = "1 day", tile: int = TILE) -> DataFrame:
    """Means of the last ``last`` rows up to each row.

    Rows of a key are numbered by blocks of time and cut in tiles of ``tile``; a tile has the last rows of the one before as well.
    """
    placed = in_blocks(history, by, order, block)
    within = W.partitionBy(by, "_block").orderBy(*order)
    nth = (F.col("_before") + F.row_number().over(within) - 1).cast("long")
    numbered = placed.withColumn("_nth", nth).drop("_block", "_before")
    own = F.floor(F.col("_nth") / tile)
    also = F.when(F.col("_nth") % tile > tile - last, F.array(own, own + 1)).otherwise(F.array(own))
    tiled = numbered.withColumn("_tile", F.explode(also))
    recent = W.partitionBy(by, "_tile").orderBy("_nth").rowsBetween(1 - last, 0)
    found = tiled.select("*", *[F.avg(v).over(recent).alias(f"recent_{v}") for v in values])
    return found.where(F.col("_tile") == own).drop("_nth", "_tile")


def last_rows(rows: DataFrame, n: int, by: str, order: list[str]) -> DataFrame:
    """The last ``n`` rows of each key."""
    newest = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")

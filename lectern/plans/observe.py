"""Metrics, index changes, exports, sources, streams and answers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import export as X
from lectern.operators import index as I
from lectern.operators import metrics as M
from lectern.operators.ask import ask
from lectern.sources import documents as D
from lectern.streaming import events as E

from .tables import chunks, documents, shared_folder, table, vector_queries


def _interactions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("value").alias("response_time"), (F.col("value") / 500).alias("relevance"), "ts", "event_id", "event_type")


def doc_stats(spark, sf_dir):
    """Lines of each document as its chunks: count, characters, mean length."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    m = M.ingestion_metrics(rows)
    return m.select("doc_id", "chunk_count", "chunk_chars", F.round("avg_chunk_length", 6).alias("avg_chunk_length"))


def library_status(spark, sf_dir):
    """Documents, chunks and embeddings in all."""
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n")).withColumn("embeddings", F.array(F.array(F.lit(0.0))))
    return M.library_status(d)


def session_metrics(spark, sf_dir):
    """Interactions by session."""
    m = M.session_metrics(_interactions(spark, sf_dir))
    return m.select("session_id", "queries", F.round("avg_response_time", 6).alias("avg_response_time"), F.round("avg_relevance", 6).alias("avg_relevance"), "duration_us")


def running_metrics(spark, sf_dir):
    """Session metrics after each interaction."""
    m = M.running_metrics(_interactions(spark, sf_dir), ("ts", "event_id"))
    return m.select("event_id", "queries_so_far", F.round("avg_response_so_far", 8).alias("avg_response_so_far"))


def sliding_perf(spark, sf_dir):
    """Mean of each session's last ten response times."""
    m = M.sliding_means(_interactions(spark, sf_dir), ["response_time"], "session_id", ["ts", "event_id"])
    return m.select("event_id", F.round("recent_response_time", 8).alias("recent"))


def last_interactions(spark, sf_dir):
    """The last twenty interactions of each session."""
    return M.last_rows(_interactions(spark, sf_dir), 20, "session_id", ["ts", "event_id"]).select("session_id", "event_id")


def perf_score(spark, sf_dir):
    """Performance and health scores with values standing for measures."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    rows = e.select("event_id", M.performance_score(v / 5, v / 6, v * 5, v, v / 40).alias("performance"))
    return rows.withColumn("health", M.health_score(F.lit(True), F.lit(1), F.lit(False), F.lit(True), "performance"))


def message_metrics(spark, sf_dir):
    """User queries, mean response time and error rate of all turns; a turn's length is its time."""
    m = table(spark, sf_dir, "conversations").withColumn("response_time", F.length("text")).withColumnRenamed("text", "content")
    return M.message_metrics(m, failed="the")


def upsert(spark, sf_dir):
    """Suppliers with changed balances put over the old rows."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_acctbal").alias("content"), F.lit(1).alias("ts"))
    new = s.where("content > 5000").select((F.col("chunk_id") + 50).alias("chunk_id"), (F.col("content") + 1).alias("content"), F.lit(2).alias("ts"))
    return I.upsert(s, new).select("chunk_id", F.round("content", 2).alias("content"), "ts")


def delete_documents(spark, sf_dir):
    """Documents without those of some sources."""
    return I.delete_documents(documents(spark, sf_dir), ["src1", "src9"], "source").select("doc_id", "source")


def merge_update(spark, sf_dir):
    """Labels merged into documents by id, where there are any."""
    d = documents(spark, sf_dir).select("doc_id", F.lit(0).alias("quality"))
    return I.merge_partial(d, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")


def distinct_sources(spark, sf_dir):
    return documents(spark, sf_dir).select("source").distinct()


def index_roundtrip(spark, sf_dir):
    """Chunks written to a fresh index, some documents deleted, and read back."""
    index = I.ChunkIndex(spark, shared_folder(spark, "index"))
    index.create()
    index.upsert(chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")))
    index.delete(["3"])
    return index.scan().select("chunk_id", "doc_id", "chunk_index")


def export_chunks_md(spark, sf_dir):
    """Documents as Markdown of their lines."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.chunks_markdown(X.bare_name(F.concat("source", F.lit(".PDF"))), F.split("text", "\n"), F.lit("2024-01-01")).alias("markdown"))


def export_chat(spark, sf_dir):
    """Conversations as Markdown."""
    return X.chat_markdown(table(spark, sf_dir, "conversations"))


def share_preview(spark, sf_dir):
    """The shared tail of each conversation."""
    return X.share_preview(table(spark, sf_dir, "conversations")).select("conv_id", "shared", "preview")


def html_fields(spark, sf_dir):
    """Title and heading of each page."""
    return table(spark, sf_dir, "pages").select("page_id", D.html_fields("html").alias("f")).select("page_id", "f.*")


def assemble_pages(spark, sf_dir):
    """Lines of documents as pages put together again, with counts and confidence."""
    p = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("ok", F.lit(True))
    return D.assemble_pages(p).select("doc_id", "pages", "successful_pages", "failed_pages", F.round("confidence", 6).alias("confidence"))


def server_extract(spark, sf_dir):
    """Text between marks in each document's bytes."""
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("name"), F.encode(F.concat(F.lit("x stream "), "text", F.lit(" endstream")), "UTF-8").alias("content"))
    return D.server_extract(d).select("doc_id", F.length("text").alias("n"), "quality")


def windowed_metrics(spark, sf_dir):
    """Events in tumbling windows of an hour."""
    m = E.windowed_metrics(table(spark, sf_dir, "events"), "1 hour")
    return m.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean_value", 6).alias("mean_value"), "errors")


def session_windows(spark, sf_dir):
    """Sessions of users, events no further apart than six hours."""
    m = E.session_windows(table(spark, sf_dir, "events"), "6 hours")
    return m.select("user_id", F.date_format("session.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_windows(spark, sf_dir):
    """The same windows from a file stream, as it stands when all has arrived."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    m = E.windowed_metrics(stream, "1 hour")
    out = shared_folder(spark, "windows")
    # a batch that runs again after a failure replaces its table whole
    query = (
        m.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.schema(m.schema).parquet(f"{out}/batch={last}").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean_value", 6).alias("mean_value"), "errors")


def stream_tokens(spark, sf_dir):
    """Words of assistant turns as tokens, gathered again in order."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    tokens = turns.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.posexplode(F.split("text", "(?<= )")).alias("seq", "token"))
    return E.gather_tokens(tokens)


def ask_offline(spark, sf_dir):
    """Answers of the offline stand-in to several questions."""
    q = vector_queries(spark, sf_dir, {0: "what is the summary of x", 7: "how does it differ, in detail? why?", 20: "where is it"})
    return ask(q, chunks(spark, sf_dir)).select("query_id", "kind", "level", "answer", F.size("retrieved").alias("n"), F.round("relevance", 6).alias("relevance"))


_I = "(SELECT user_id AS session_id, value AS response_time, value / 500 AS relevance, ts, event_id FROM events)"
_HOURS = """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS mean_value,
 count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL"""
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents)"
_SURE = r"""CASE WHEN length(t) = 0 THEN 0 ELSE greatest(0, least(100, 50 + CASE WHEN length(t) > 100 THEN 20 ELSE 0 END + CASE WHEN length(t) > 500 THEN 10 ELSE 0 END
 + CASE WHEN len(regexp_split_to_array(t, '\s+')) > 20 THEN 10 ELSE 0 END + CASE WHEN len(regexp_split_to_array(t, '\s+')) > 100 THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(t, '[.!?]') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Z][a-z]') THEN 5 ELSE 0 END
 - CASE WHEN length(t) < 50 THEN 20 ELSE 0 END - CASE WHEN regexp_matches(t, '[a-zA-Z]') THEN 0 ELSE 30 END)) END"""

QUERIES = {
    f.__name__: f
    for f in (
        doc_stats, library_status, session_metrics, running_metrics, sliding_perf, last_interactions, perf_score, message_metrics,
        upsert, delete_documents, merge_update, distinct_sources, index_roundtrip, export_chunks_md, export_chat, share_preview,
        html_fields, assemble_pages, server_extract, windowed_metrics, session_windows, stream_windows, stream_tokens, ask_offline,
    )
}
ORACLES = {
    "doc_stats": f"SELECT doc_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS chunk_chars, round(avg(length(content)), 6) AS avg_chunk_length FROM {_LINES} GROUP BY doc_id",
    "library_status": "SELECT count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS chunks, count(*) AS embeddings FROM documents",
    "session_metrics": f"""SELECT session_id, count(*) AS queries, round(avg(response_time), 6) AS avg_response_time, round(avg(relevance), 6) AS avg_relevance,
 epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM {_I} GROUP BY session_id""",
    "running_metrics": f"""SELECT event_id, count(*) OVER w AS queries_so_far, round(avg(response_time) OVER w, 8) AS avg_response_so_far FROM {_I}
 WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "sliding_perf": f"SELECT event_id, round(avg(response_time) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS 9 PRECEDING), 8) AS recent FROM {_I}",
    "last_interactions": f"""SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS n FROM {_I}) WHERE n <= 20""",
    "perf_score": """SELECT event_id, p AS performance, least(100, 25 + 20 + 15 + CASE WHEN p > 80 THEN 25 ELSE 0 END) AS health FROM (SELECT event_id, greatest(0, 100
 - CASE WHEN value / 5 > 80 THEN 20 WHEN value / 5 > 60 THEN 10 ELSE 0 END - CASE WHEN value / 6 > 80 THEN 15 WHEN value / 6 > 60 THEN 8 ELSE 0 END
 - CASE WHEN value * 5 > 2000 THEN 15 WHEN value * 5 > 1000 THEN 8 ELSE 0 END - CASE WHEN value > 500 THEN 10 WHEN value > 200 THEN 5 ELSE 0 END
 - CASE WHEN value / 40 > 10 THEN 20 WHEN value / 40 > 5 THEN 10 ELSE 0 END) AS p FROM events)""",
    "message_metrics": """SELECT count(*) FILTER (WHERE role = 'user') AS total_queries,
 floor(avg(length(text)) FILTER (WHERE role = 'assistant') + 0.5)::BIGINT AS avg_response_time,
 floor(count(*) FILTER (WHERE contains(text, 'the')) / count(*) * 100 * 10 + 0.5) / 10 AS error_rate,
 floor((100 - count(*) FILTER (WHERE contains(text, 'the')) / count(*) * 100) * 10 + 0.5) / 10 AS success_rate FROM conversations""",
    "upsert": """WITH n AS (SELECT s_suppkey + 50 AS chunk_id, s_acctbal + 1 AS content FROM supplier WHERE s_acctbal > 5000)
SELECT s_suppkey AS chunk_id, round(s_acctbal, 2) AS content, 1 AS ts FROM supplier WHERE s_suppkey NOT IN (SELECT chunk_id FROM n)
UNION ALL SELECT chunk_id, round(content, 2), 2 FROM n""",
    "delete_documents": "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src9')",
    "merge_update": "SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "index_roundtrip": """SELECT e.vec_id::VARCHAR AS chunk_id, e.label::VARCHAR AS doc_id, e.vec_id::INTEGER AS chunk_index
 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.label <> 3""",
    "export_chunks_md": """SELECT doc_id, '# Document Chunks: ' || source || chr(10) || chr(10) || 'Exported: 2024-01-01' || chr(10) || 'Total Chunks: ' || len(c)
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || array_to_string(list_transform(c, lambda x, i: '## Chunk ' || i || chr(10) || chr(10) || x
 || chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') AS markdown FROM (SELECT doc_id, source, string_split(text, chr(10)) AS c FROM documents)""",
    "export_chat": """SELECT conv_id, string_agg('## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || text || chr(10) || chr(10)
 || '---' || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""",
    "share_preview": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE n <= 10) AS shared, string_agg(CASE WHEN role = 'user' THEN 'U: ' ELSE 'A: ' END || substr(text, 1, 100)
 || CASE WHEN length(text) > 100 THEN '...' ELSE '' END, chr(10) ORDER BY turn) FILTER (WHERE n <= 3) AS preview FROM r GROUP BY conv_id""",
    "html_fields": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages",
    "assemble_pages": f"""SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE trim(t) <> '') AS successful_pages, count(*) FILTER (WHERE trim(t) = '') AS failed_pages,
 round(coalesce(avg({_SURE}) FILTER (WHERE trim(t) <> ''), 0), 6) AS confidence FROM (SELECT doc_id, content AS t FROM {_LINES}) GROUP BY doc_id""",
    "server_extract": r"""WITH b AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(regexp_replace(text, '[^\x20-\x7E]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n,
 octet_length(encode(array_to_string(list_filter(list_transform(regexp_extract_all(text, '\$\$[^)]+\$\$'), lambda m: substr(m, 2, length(m) - 2)),
  lambda m: length(m) > 2 AND regexp_matches(m, '[a-zA-Z]')), ' '))) AS m FROM documents
), f AS (SELECT doc_id, source, CASE WHEN n > 10 AND m > 10 THEN m + 2 + n WHEN n > 10 THEN n WHEN m > 10 THEN m ELSE 0 END AS n FROM b)
SELECT doc_id, CASE WHEN n < 50 THEN length('No text could be extracted from ' || source || '.') ELSE n END::INTEGER AS n,
 CASE WHEN n < 50 OR n > 200 THEN 'medium' ELSE 'low' END AS quality FROM f""",
    "windowed_metrics": _HOURS,
    "stream_windows": _HOURS,
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, nth""",
    "stream_tokens": "SELECT conv_id || '-' || turn AS message_id, text AS content FROM conversations WHERE role = 'assistant'",
}

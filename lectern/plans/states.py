"""Readiness, reports, dates, prompts and whole vectors over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import ask as A
from lectern.operators import filters as P
from lectern.operators import ingest as N
from lectern.operators import logs as L
from lectern.operators import metrics as M
from lectern.sources import documents as D

from .library import _INGESTED
from .tables import documents, shared_folder, table
from .text import _KIND


def system_report(spark, sf_dir):
    """The report on a library whose documents have lines as chunks and four vectors at most."""
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    d = d.withColumn("embeddings", F.transform(F.slice("chunks", 1, 4), lambda x: F.array(F.lit(1.0), F.lit(2.0))))
    return M.system_report(M.library_status(d), M.document_diagnostics(d, "text"), "local", None)


def engine_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", M.engine_state(F.col("event_id") % 7 > 0, F.col("user_id") % 3 > 0, F.col("event_id") % 5).alias("state"))


def metadata_dates(spark, sf_dir):
    """Dates of orders as files give them: whole, cut off, with offsets, in ISO 8601, or of no use."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    given = (
        F.when(k % 5 == 0, F.concat(F.lit("D:"), stamp, F.lit("134501+02'30'"))).when(k % 5 == 1, F.concat(F.lit("D:"), F.substring(stamp, 1, 6)))
        .when(k % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 5 == 3, F.concat(F.lit("D:"), stamp, F.lit("235959-0100"))).otherwise("last week")
    )
    m = D.document_metadata(F.lit(""), F.lit(None).cast("string"), F.lit("s"), F.lit("f.pdf"), given, F.lit("x"))
    found = o.select("o_orderkey", m.alias("m"))
    created = F.col("m.created")
    return found.select("o_orderkey", "m.title", F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("created"), T.locale_date(created).alias("day"), T.locale_time(created).alias("time"), F.col("m.modified").isNull().alias("none"))


def prompts_by_kind(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("role = 'user'")
    return m.select("conv_id", "turn", A.system_prompt(T.question_type("text")).alias("prompt"))


def message_lines(spark, sf_dir):
    """Each conversation as lines of role and content, as some models take it."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return m.select("conv_id", A.chat_lines("messages").alias("lines"))


def documents_sound(spark, sf_dir):
    """Documents whose chunks and vectors pair up and have the dimension of the question."""
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    vectors = F.transform(F.slice("chunks", 1, 6), lambda x: F.array_repeat(F.lit(1.0), F.col("doc_id").cast("int") % 3 + 1))
    return d.withColumn("embeddings", vectors).where(P.sound_embedding("chunks", "embeddings", 2)).select("doc_id")


def pages_as_one(spark, sf_dir):
    """Documents whose pages are their lines' words, joined by blank lines; every ninth page gave nothing."""
    p = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return D.joined_pages(p.withColumn("text", F.when((F.col("doc_id") + F.col("page")) % 9 > 0, F.col("text"))))


def log_cleared(spark, sf_dir):
    """A log that was cleared holds what was written after that."""
    path = shared_folder(spark, "log")
    e = table(spark, sf_dir, "events")
    rows = L.metric_events(e, "user_id", "event_id", "event_type", "value")
    L.append(rows, path)
    L.clear(spark, path)
    L.append(rows.where("seq % 10 = 0"), path)
    return L.read_log(spark, path, "metrics").select("session_id", "seq", F.get_json_object("payload", "$.event_type").alias("kind"))


def ingest_vectors(spark, sf_dir):
    """Vectors of ingested chunks whole, as a digest of their numbers."""
    rows, _ = N.ingest(documents(spark, sf_dir), "plain")
    # most numbers are 0, and formats are dear
    numbers = F.array_join(F.transform("embedding", lambda x: F.when(x == 0, "0.0000000").otherwise(F.format_string("%.7f", x))), " ")
    return rows.select("doc_id", "chunk_index", F.md5(numbers).alias("digest"))


_FORMATS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.FORMATS.items())
QUERIES = {
    f.__name__: f
    for f in (system_report, engine_states, metadata_dates, prompts_by_kind, message_lines, documents_sound, pages_as_one, log_cleared, ingest_vectors)
}
ORACLES = {
    "system_report": """WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)
SELECT 'status' AS section, 0 AS nth, '- **State:** no model' || chr(10) || '- **Provider:** local' || chr(10) || '- **Model:** Not Set' || chr(10) || '- **Documents:** ' || count(*)
 || chr(10) || '- **Total Chunks:** ' || sum(n) || chr(10) || '- **Total Embeddings:** ' || sum(least(4, n)) || chr(10) AS text FROM d
UNION ALL SELECT 'document', doc_id, '- **Chunks:** ' || n || chr(10) || '- **Embeddings:** ' || least(4, n) || chr(10) || '- **Valid Structure:** ' || CASE WHEN n <= 4 THEN 'yes' ELSE 'no' END
 || chr(10) || '- **Embedding Dimension:** 2' || chr(10) || '- **Preview:** ' || substr(text, 1, 100) || '...' || chr(10) FROM d""",
    "engine_states": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not initialized' WHEN user_id % 3 = 0 THEN 'no model' WHEN event_id % 5 = 0 THEN 'no documents' ELSE 'ready' END AS state FROM events""",
    "metadata_dates": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL '13 hours 45 minutes 1 second' - INTERVAL '2 hours 30 minutes'
 WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN o_orderdate WHEN 3 THEN date_trunc('day', o_orderdate) + INTERVAL '23 hours 59 minutes 59 seconds' + INTERVAL '1 hour' END::TIMESTAMP AS t FROM orders)
SELECT o_orderkey, 'f.pdf' AS title, strftime(t, '%Y-%m-%d %H:%M:%S') AS created, coalesce(strftime(t, '%-m/%-d/%Y'), 'Unknown') AS day, strftime(t, '%-m/%-d/%Y, %-I:%M:%S %p') AS time, true AS none FROM t""",
    "prompts_by_kind": f"""SELECT conv_id, turn, '{A.INSTRUCTIONS}' || chr(10) || chr(10) || CASE kind {_FORMATS_SQL} END AS prompt
 FROM (SELECT conv_id, turn, {_KIND} AS kind FROM conversations WHERE role = 'user')""",
    "message_lines": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id",
    "documents_sound": "SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) <= 6 AND doc_id % 3 = 1",
    "pages_as_one": """SELECT doc_id, string_agg(CASE WHEN (doc_id + page) % 9 > 0 THEN line ELSE '' END, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS pages
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents) GROUP BY doc_id""",
    "log_cleared": "SELECT user_id::VARCHAR AS session_id, event_id AS seq, event_type AS kind FROM events WHERE event_id % 10 = 0",
    "ingest_vectors": f"""WITH r AS MATERIALIZED (SELECT doc_id, chunk_index, content FROM {_INGESTED}
), c AS (SELECT doc_id, chunk_index, unicode(unnest(string_split(content, ''))) AS code FROM r
), s AS (SELECT doc_id, chunk_index, code % 384 AS place, sum(code) / 128 AS x FROM c GROUP BY ALL
), m AS (SELECT doc_id, chunk_index, map_from_entries(list(row(place, x))) AS m FROM s GROUP BY ALL)
SELECT doc_id, chunk_index, md5(array_to_string(list_transform(range(384), lambda i: printf('%.7f', coalesce(m[i], 0.0))), ' ')) AS digest FROM m""",
}

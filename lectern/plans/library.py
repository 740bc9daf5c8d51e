"""Ingest, requests, logs, exports, page items, events and formats over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import export as X
from lectern.operators import index as I
from lectern.operators import ingest as N
from lectern.operators import logs as L
from lectern.operators import metrics as M
from lectern.operators import requests as R
from lectern.operators.ask import ask, context_prompt, critique_prompt, find_relevant_chunks, query_simple, refinement_prompt
from lectern.sources import documents as D
from lectern.streaming import events as E

from .tables import CHUNKS_SQL, chunks, documents, shared_folder, table, trim_sql, vector_queries
from .text import _PARAGRAPH_ROWS, _paragraphs


def _items(spark, sf_dir):
    """Words of passages as items of two pages, laid out by rule: nine a line, some lines a bit off, every fifth with a gap."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", " ")).alias("n", "str"))
    n = F.col("n")
    return b.select(
        "doc_id", (n % 2 + 1).cast("int").alias("page"), n.alias("pos"), "str", ((n % 18) * 9 + F.when(n % 5 == 0, 40).otherwise(0)).cast("double").alias("x"),
        (F.lit(700) - F.floor(n / 18) * 12 + (n % 3) * 1.2).cast("double").alias("y"),
    )


def file_checks(spark, sf_dir):
    """Why documents taken as files of some size and type are refused."""
    d = documents(spark, sf_dir)
    mime, size = F.when(F.col("lang") == "en", "application/pdf").otherwise("text/plain"), (F.col("n_chars") - 100) * 20_000
    return d.select("doc_id", *[F.coalesce(D.reject_reason(mime, size, p), F.lit("")).alias(p) for p in D.MOST_BYTES])


def pages_joined(spark, sf_dir):
    return D.page_text_joined(_items(spark, sf_dir))


def pages_flow(spark, sf_dir):
    return D.page_text_flow(_items(spark, sf_dir))


def pages_lines(spark, sf_dir):
    return D.page_text_lines(_items(spark, sf_dir))


def pages_basic(spark, sf_dir):
    """Passages by page under the marks of the basic reader; every third page failed."""
    pages = D.page_text_joined(_items(spark, sf_dir)).withColumn("ok", (F.col("doc_id") + F.col("page")) % 3 != 0)
    return D.assemble_pages(pages, "basic").select("doc_id", "text", "successful_pages", "failed_pages", "quality")


def pages_advanced(spark, sf_dir):
    pages = D.page_text_flow(_items(spark, sf_dir)).withColumn("ok", (F.col("doc_id") + F.col("page")) % 4 != 0)
    return D.assemble_pages(pages, "advanced").select("doc_id", "text", "successful_pages", "quality")


def metadata_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    title = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    author = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return c.select("c_custkey", D.document_metadata(title, author, F.lit(None).cast("string"), "c_name").alias("m")).select("c_custkey", "m.*")


def extraction_fallbacks(spark, sf_dir):
    """The first reader that gives text, by rules that stand for readers."""
    d = documents(spark, sf_dir)
    first, second = F.when(F.col("lang") == "en", F.col("text")), F.when(F.col("n_chars") < 900, F.concat(F.lit("  "), F.col("source")))
    return d.select("doc_id", D.with_fallbacks(first, second).alias("a")).select("doc_id", "a.*")


def plain_files(spark, sf_dir):
    """Texts as UTF-8 bytes and back."""
    return documents(spark, sf_dir).select("doc_id", D.plain_text(F.encode("text", "UTF-8")).alias("text"))


def settings_migrate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    state = F.to_json(F.struct(F.lower("c_mktsegment").alias("provider"), F.col("c_name").alias("model")))
    return c.select("c_custkey", D.migrate_settings(state, ["building", "machinery"], "furniture").alias("s")).select("c_custkey", "s.*")


def embedding_replies(spark, sf_dir):
    """Vectors from replies of three forms, and of one that holds none."""
    d = documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("string").alias("n"))
    kind = F.col("doc_id") % 4
    payload = (
        F.when(kind == 0, F.concat(F.lit("["), "n", F.lit(", 2]"))).when(kind == 1, F.concat(F.lit("[["), "n", F.lit("], [7]]")))
        .when(kind == 2, F.concat(F.lit('{"embedding": ['), "n", F.lit("]}"))).otherwise("oops")
    )
    v = D.normalize_embedding(payload)
    return d.select("doc_id", F.coalesce(F.size(v), F.lit(-1)).alias("dims"), F.get(v, F.lit(0)).alias("first"))


def ingest_progress(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.round(D.ingest_progress(F.col("doc_id") % 7, F.lit(7)), 6).alias("percent"))


def chunk_offsets(spark, sf_dir):
    """Paragraph chunks with where their last paragraph stands."""
    d = documents(spark, sf_dir).select("doc_id", _paragraphs().alias("text"))
    return C.chunk_rows(d, C.chunk_paragraphs("text", 1000, 150)).select("doc_id", "chunk_index", "start_char", F.length("content").alias("n"))


def zipped_vectors(spark, sf_dir):
    """Lines and vectors of documents zipped by position; there are fewer vectors than lines in some."""
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    vectors = F.transform(F.sequence(F.lit(1), F.col("doc_id").cast("int") % 3 + 1), lambda i: F.array(i.cast("double"), F.lit(1.0)))
    rows = C.vector_rows(d.withColumn("embeddings", vectors), name="author")
    return rows.select("chunk_id", "doc_id", "source", "content", F.size("embedding").alias("dims"))


def ingest_documents(spark, sf_dir):
    """Documents to chunk rows whose size follows the text's length, embedded."""
    rows, _ = N.ingest(documents(spark, sf_dir), "plain")
    return rows.select("doc_id", "chunk_id", "chunk_index", "content", F.size("embedding").alias("dims"), "embedder")


def ingest_refused(spark, sf_dir):
    """Documents that can't be ingested: here those in French, whose text is blanked."""
    d = documents(spark, sf_dir).withColumn("text", F.when(F.col("lang") == "fr", " \n").otherwise(F.col("text")))
    return N.ingest(d, "plain")[1].select("doc_id", "problem")


def regenerate_embeddings(spark, sf_dir):
    """Passages embedded again where their vector was missing or another embedder's."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    b = b.withColumn("embedder", F.when(F.col("item_id") % 3 == 0, "plain").when(F.col("item_id") % 3 == 1, "hashed"))
    return N.regenerate(b, "plain").select("item_id", "embedder", "regenerated", F.size("embedding").alias("dims"))


def document_checks(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("chunks", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 400))
    vectors = F.transform("chunks", lambda x: F.when(F.length(x) % 5 > 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))
    d = d.withColumn("embeddings", F.when(F.col("doc_id") % 4 == 0, F.slice(vectors, 2, 10_000)).otherwise(vectors))
    return N.checked_documents(d).select("doc_id", F.coalesce("problem", F.lit("")).alias("problem"), "regenerate")


def cascade_delete(spark, sf_dir):
    """Documents, chunks and labels without some documents: what is left of each."""
    d, c, la = documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), table(spark, sf_dir, "labels").select("doc_id")
    left = N.cascade_delete([3, 5, 8, 144], d, c, la)
    named = [t.select(F.lit(name).alias("of"), F.col("doc_id").cast("long").alias("doc_id")) for name, t in zip(("documents", "chunks", "labels"), left)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def diagnostics(spark, sf_dir):
    """Counts, pairing, preview and report of each document."""
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    d = d.withColumn("embeddings", F.transform(F.slice("chunks", 1, 4), lambda x: F.array(F.lit(1.0), F.lit(2.0))))
    found = M.document_diagnostics(d, "text")
    return found.join(M.diagnostic_report(found), "doc_id").select("doc_id", "n_chunks", "n_embeddings", "sound", "preview", "dimension", "report")


def interaction_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.repeat("text", F.lit(2)).alias("response"), F.split("text", " ").alias("sources"))
    return M.interaction_metrics(m).select("conv_id", "turn", "query_length", "response_length", "source_count")


def library_totals(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    d = d.withColumns({"size": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), "file_size": F.lit(0), "content": F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("")})
    return M.library_totals(d.withColumn("confidence", F.col("doc_id") % 100))


def estimates(spark, sf_dir):
    """Memory and load estimates with event values as measures."""
    e = table(spark, sf_dir, "events").withColumn("duration", F.col("value") / 2)
    cpu = M.cpu_estimate(e, "duration", "user_id", ["ts", "event_id"])
    kind = F.when(F.col("event_type") == "error", "processing").when(F.col("event_type") == "click", "active")
    return cpu.select(
        "event_id", F.round("cpu", 6).alias("cpu"), F.round(M.memory_estimate(F.col("user_id") % 7, F.col("event_id") % 9, F.lit(10)), 6).alias("memory"),
        M.activity_load(kind).alias("load"),
    )


def requests_checked(spark, sf_dir):
    """Requests that can't be answered, and hybrid ones that degrade."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mode = F.element_at(F.array(*map(F.lit, (*R.MODES, "fuzzy"))), (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4)) + 1).cast("int"))
    question = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text"))
    vector = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    found = R.checked_requests(m.withColumns({"question": question, "mode": mode, "embedding": vector}), 3)
    return found.select("conv_id", "turn", F.coalesce("problem", F.lit("")).alias("problem"), "effective", "embedding_generated")


def result_defaults(spark, sf_dir):
    """Results as shown, with some of their fields missing; the score comes from a distance."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.when(F.col("vec_id") % 3 > 0, F.col("vec_id")).alias("chunk_id"), F.when(F.col("vec_id") % 4 > 0, F.col("label")).alias("doc_id"),
        F.when(F.col("vec_id") % 5 > 0, F.concat(F.lit("s"), F.col("label").cast("string"))).otherwise("").alias("source"),
        F.when(F.col("vec_id") % 2 > 0, F.col("vec_id").cast("int")).alias("chunk_index"), (F.col("vec_id") + 1).alias("rank"),
        R.distance_score(F.col("vec_id") / 1024).alias("score"),
    )
    return R.with_defaults(rows, "hybrid").select("rank", "id", "source", "document", "chunk_index", "search_mode", "score")


def tab_badges(spark, sf_dir):
    return R.tab_badges(documents(spark, sf_dir), table(spark, sf_dir, "conversations"))


def event_log(spark, sf_dir):
    """Metrics, errors and runs of users appended to one log and read back."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").withColumn("message", F.when(F.col("event_id") % 2 == 0, "rate limit hit").otherwise("API key missing"))
    path = shared_folder(spark, "log")
    L.append(L.run_events(e, "user_id", "event_id"), path)
    L.append(L.metric_events(e, "user_id", "event_id", "event_type"), path)
    L.append(L.error_events(errors, "user_id", "event_id", "event_type", "message"), path)
    return L.read_log(spark, path)


def index_append(spark, sf_dir):
    """Rows appended twice to an index are there twice; after clearing, none but those added later."""
    index = I.ChunkIndex(spark, shared_folder(spark, "index"))
    index.create()
    rows = chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    index.append(rows)
    index.append(rows)
    twice = index.count()
    index.clear()
    index.append(rows.where("chunk_index < 50"))
    return index.scan().select("chunk_id", F.lit(twice).alias("before"))


def export_library(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    kind = F.when(F.col("doc_id") % 2 == 0, "application/pdf")
    return d.select("doc_id", X.library_entry("doc_id", "source", F.col("n_chars"), kind, F.size("chunks"), F.get("chunks", F.lit(0))).alias("entry"))


def export_chat_text(spark, sf_dir):
    return X.chat_text(table(spark, sf_dir, "conversations"))


def export_chat_json(spark, sf_dir):
    return X.chat_json(table(spark, sf_dir, "conversations"))


def export_document_json(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.document_json("doc_id", "source", "lang").alias("json"))


def share_link(spark, sf_dir):
    """What a share link holds of each conversation."""
    link = X.share_preview(table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"[^a-zA-Z ]", ""))).select("conv_id", "link")
    return link.select("conv_id", F.decode(F.unbase64("link"), "UTF-8").alias("held"))


def scalar_formats(spark, sf_dir):
    """Shares, labels, previews, dates and defaults of orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", T.confidence_share((k % 300) / 2.0).alias("share"), T.first_given(F.when(k % 2 == 0, "").otherwise("ocr"), F.lit("direct")).alias("method"),
        T.size_label(k % 5000).alias("label"), T.iso_date("o_orderdate").alias("day"), T.thinking_preview(F.repeat("o_orderstatus", (k % 400).cast("int"))).alias("preview"),
        T.source_label("o_orderstatus", (k % 9).cast("int")).alias("source"), T.source_document(T.source_label("o_orderstatus", (k % 9).cast("int"))).alias("document"),
        T.response_time(k % 3000).alias("time"),
    )


def error_kinds(spark, sf_dir):
    messages = ("Invalid API key given", "HTTP 401", "no such model", "HTTP 404", "rate limit reached", "network is down", "needs a password", "Invalid PDF structure", "fetch failed: 429", "odd")
    e = table(spark, sf_dir, "events")
    m = F.element_at(F.array(*map(F.lit, messages)), (F.col("event_id") % len(messages) + 1).cast("int"))
    return e.select("event_id", T.error_kind(m).alias("kind"))


def prompts(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").where("role = 'user'")
    q = F.col("text")
    return m.select(
        "conv_id", "turn", context_prompt(q, F.lit("c")).alias("context"), critique_prompt(q, F.lit("a")).alias("critique"),
        refinement_prompt(q, F.lit("a"), F.lit("r")).alias("refinement"), T.offline_answer(F.concat(F.lit("find the summary "), q)).alias("offline"),
    )


def thinking_parts(spark, sf_dir):
    """Parts of turns with a thinking part in the middle."""
    m = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    parts = T.thinking_parts(F.concat(F.lit("first <think>so "), F.col("turn").cast("string"), F.lit("</think> last")))
    return m.select("conv_id", "turn", F.posexplode(parts).alias("nth", "p")).select("conv_id", "turn", "nth", "p.type", "p.content")


def stage_events(spark, sf_dir):
    m = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return E.stage_events(m)


def events_parsed(spark, sf_dir):
    """Stage events as one stream of text for each request, read back."""
    m = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    lines = E.stage_events(m).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "").alias("t"))
    parsed = lines.select("query_id", F.posexplode(E.parse_events(F.concat("t", F.lit("data: [DONE]\n\n")))).alias("seq", "e"))
    return parsed.select("query_id", "seq", "e.stage", "e.status")


def stage_states(spark, sf_dir):
    """States of stages from part of their events; every third request fails at the end."""
    e = events_parsed(spark, sf_dir).where(F.col("seq") < F.col("query_id") % 9).withColumn("error", F.lit(None).cast("string"))
    failed = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(
        F.col("item_id").alias("query_id"), F.lit(99).alias("seq"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("status"), F.lit("x").alias("error")
    )
    return E.stage_states(e.unionByName(failed))


_ASKED = {0: "what is the summary of x", 7: "how does it differ, in detail? why?", 20: "where is it"}


def relevant_chunks(spark, sf_dir):
    """The diverse best chunks of each question."""
    found = find_relevant_chunks(vector_queries(spark, sf_dir, _ASKED), chunks(spark, sf_dir), 6)
    return found.select("query_id", "rank", "chunk_id", "label", F.round("similarity", 6).alias("similarity"))


def ask_echo(spark, sf_dir):
    """Answers of a generator that says how long its prompt is, from retrieval to usage."""
    said = lambda p: F.concat(F.lit("Source of "), F.length(p).cast("string"))
    got = ask(vector_queries(spark, sf_dir, _ASKED), chunks(spark, sf_dir), token_budget=100_000, level="normal", generate=said)
    return got.select(
        "query_id", "kind", "answer", F.array_join("sources", ";").alias("sources"), F.round("relevance", 6).alias("relevance"), "critique",
        F.size("retrieved").alias("n"), F.round("quality.rating", 6).alias("rating"), F.col("tokens.total").alias("tokens"),
    )


def ask_simple(spark, sf_dir):
    said = lambda p: F.concat(F.lit("Source of "), F.length(p).cast("string"))
    got = query_simple(vector_queries(spark, sf_dir, _ASKED), chunks(spark, sf_dir), token_budget=100_000, generate=said)
    return got.select("query_id", "answer", F.size("retrieved").alias("n"))


def ask_nothing(spark, sf_dir):
    """Questions to an empty library."""
    got = ask(vector_queries(spark, sf_dir, _ASKED), chunks(spark, sf_dir).where("false"))
    return got.select("query_id", "answer", "relevance", F.size("retrieved").alias("n"))


_ITEMS = """(SELECT item_id AS doc_id, (n % 2 + 1)::INTEGER AS page, n AS pos, str, ((n % 18) * 9 + CASE WHEN n % 5 = 0 THEN 40 ELSE 0 END)::DOUBLE AS x,
 (700 - (n // 18) * 12 + (n % 3) * 1.2)::DOUBLE AS y FROM (SELECT item_id, unnest(string_split(text, ' ')) AS str, unnest(range(len(string_split(text, ' ')))) AS n FROM benchmark))"""
_JOINED = f"(SELECT doc_id, page, coalesce(string_agg(str, ' ' ORDER BY pos) FILTER (WHERE {trim_sql('str')} <> ''), '') AS text FROM {_ITEMS} GROUP BY doc_id, page)"
_FLOW = f"""(SELECT doc_id, page, {trim_sql(r"regexp_replace(string_agg(lead || str, '' ORDER BY pos), '\s+', ' ', 'g')")} AS text FROM (
 SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 5 THEN chr(10) WHEN x - lag(x) OVER w > 10 THEN ' ' ELSE '' END AS lead FROM {_ITEMS}
 WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)) GROUP BY doc_id, page)"""
_ADAPTIVE = "CASE WHEN length(text) > 20000 THEN 1000 WHEN length(text) > 10000 THEN 800 WHEN length(text) > 5000 THEN 600 ELSE 400 END"
_INGESTED = rf"""(WITH cut AS (SELECT doc_id, {_ADAPTIVE} AS size, text, list_filter(regexp_split_to_array({trim_sql('text')}, '\s+'), lambda w: w <> '') AS ws FROM documents
), f AS (SELECT doc_id, list_reduce(list_prepend(NULL, list_transform(ws, lambda w: {{'out': []::VARCHAR[], 'cur': w, 'size': size}})), lambda s, x:
  CASE WHEN s IS NULL THEN x WHEN length(s.cur) + length(x.cur) + 1 > x.size THEN {{'out': list_append(s.out, s.cur), 'cur': x.cur, 'size': x.size}}
  ELSE {{'out': s.out, 'cur': s.cur || ' ' || x.cur, 'size': x.size}} END) AS s FROM cut WHERE len(ws) > 0 AND NOT contains(text, 'certificate') AND NOT contains(text, 'awarded to')
), c AS (SELECT doc_id, list_append(s.out, s.cur) AS c FROM f UNION ALL SELECT doc_id, [{trim_sql('text')}] FROM documents WHERE contains(text, 'certificate') OR contains(text, 'awarded to')
), r AS (SELECT doc_id, unnest(c) AS content, unnest(range(len(c)))::INTEGER AS i FROM c)
SELECT doc_id, i AS chunk_index, CASE WHEN i = 0 THEN content ELSE lag(content) OVER (PARTITION BY doc_id ORDER BY i) || chr(10) || content END AS content FROM r)"""
_SIZE = r"""CASE WHEN n <= 0 THEN '0 Bytes' WHEN n < 1024 THEN n || ' Bytes' WHEN n < 1048576 THEN regexp_replace(printf('%.2f', round(n / 1024, 2)), '\.?0+$', '') || ' KB'
 ELSE regexp_replace(printf('%.2f', round(n / 1048576, 2)), '\.?0+$', '') || ' MB' END"""
_STAGE_ROWS = """(SELECT query_id, seq::INTEGER AS seq, ['search', 'ranking', 'context', 'answer'][seq // 2 + 1] AS stage, CASE WHEN seq % 2 = 0 THEN 'in_progress' ELSE 'done' END AS status
 FROM (SELECT item_id AS query_id, unnest(range(8)) AS seq FROM benchmark))"""
_BUDGETS = {"enhanced": 104857600, "server": 52428800, "advanced": 52428800}
_REFUSED = "CASE WHEN lang IS DISTINCT FROM 'en' THEN 'not a PDF' WHEN (n_chars - 100) * 20000 <= 0 THEN 'empty file' WHEN (n_chars - 100) * 20000 > {} THEN 'file too large' ELSE '' END"
_ASKED_SQL = " UNION ALL ".join(f"SELECT {k} AS query_id, '{v}' AS question" for k, v in _ASKED.items())


def _found(k: str) -> str:
    return f"""
WITH c AS ({CHUNKS_SQL}), q AS (SELECT x.query_id, x.question, e.embedding::DOUBLE[] AS qv FROM ({_ASKED_SQL}) x JOIN embeddings e ON e.vec_id = x.query_id
), p AS (SELECT query_id, question, chunk_id, doc_id, chunk_index, content, source || ' (chunk ' || (chunk_index + 1) || ')' AS label, source, list_cosine_similarity(v, qv) AS s FROM c, q
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, doc_id, chunk_index) AS nth FROM p WHERE s >= 0.05
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, s DESC, doc_id, chunk_index) AS rank FROM n
), f AS (SELECT * FROM o WHERE rank <= {k})"""


_KIND = "CASE query_id WHEN 0 THEN 'summary' WHEN 7 THEN 'analysis' ELSE 'general' END"
_LIMIT = "CASE query_id WHEN 0 THEN 8 WHEN 7 THEN 6 ELSE 5 END"
_ANSWERED = f"""{_found(_LIMIT)}, a AS (SELECT query_id, any_value(question) AS question, count(*) AS n, avg(s) AS relevance, string_agg(label, ';' ORDER BY rank) AS sources,
 arg_min(s, rank) AS best, 9 + length(string_agg(content, chr(10) || chr(10) ORDER BY rank)) + 12 + length(any_value(question)) AS p FROM f GROUP BY query_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        file_checks, pages_joined, pages_flow, pages_lines, pages_basic, pages_advanced, metadata_defaults, extraction_fallbacks, plain_files,
        settings_migrate, embedding_replies, ingest_progress, chunk_offsets, zipped_vectors, ingest_documents, ingest_refused,
        regenerate_embeddings, document_checks, cascade_delete, diagnostics, interaction_metrics, library_totals, estimates, requests_checked,
        result_defaults, tab_badges, event_log, index_append, export_library, export_chat_text, export_chat_json, export_document_json,
        share_link, scalar_formats, error_kinds, prompts, thinking_parts, stage_events, events_parsed, stage_states, relevant_chunks, ask_echo,
        ask_simple, ask_nothing,
    )
}
ORACLES = {
    "file_checks": "SELECT doc_id, " + ", ".join(f"{_REFUSED.format(n)} AS {p}" for p, n in _BUDGETS.items()) + " FROM documents",
    "pages_joined": f"SELECT * FROM {_JOINED}",
    "pages_flow": f"SELECT * FROM {_FLOW}",
    "pages_lines": rf"""WITH i AS (SELECT *, floor(y + 0.5) AS ry FROM {_ITEMS} WHERE {trim_sql('str')} <> ''
), s AS (SELECT *, CASE WHEN abs(ry - lag(ry) OVER w) > 3 THEN 1 ELSE 0 END AS starts FROM i WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)
), l AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY pos) AS line FROM s
), t AS (SELECT doc_id, page, line, arg_min(ry, pos) AS top, string_agg(str, ' ' ORDER BY pos) AS text FROM l GROUP BY ALL
), g AS (SELECT doc_id, page, {trim_sql(r"regexp_replace(string_agg(text, ' ' ORDER BY top DESC, line), '\s+', ' ', 'g')")} AS text FROM t GROUP BY ALL)
SELECT a.doc_id, a.page, coalesce(g.text, '') AS text FROM (SELECT DISTINCT doc_id, page FROM {_ITEMS}) a LEFT JOIN g USING (doc_id, page)""",
    "pages_basic": f"""WITH p AS (SELECT *, (doc_id + page) % 3 <> 0 AS ok FROM {_JOINED}
), d AS (SELECT doc_id, {trim_sql("string_agg(CASE WHEN NOT ok THEN chr(10) || chr(10) || '--- Page ' || page || ' (Processing Error) ---' || chr(10) WHEN text = '' THEN '' ELSE chr(10) || chr(10) || '--- Page ' || page || ' ---' || chr(10) || text END, '' ORDER BY page)")} AS text,
 count(*) AS n, count(*) FILTER (WHERE ok AND text <> '') AS successful_pages FROM p GROUP BY doc_id)
SELECT doc_id, text, successful_pages, n - successful_pages AS failed_pages, CASE WHEN successful_pages / n >= 0.9 AND length(text) / n > 500 THEN 'high'
 WHEN successful_pages / n >= 0.7 AND length(text) / n > 200 THEN 'medium' ELSE 'low' END AS quality FROM d""",
    "pages_advanced": f"""WITH p AS (SELECT *, (doc_id + page) % 4 <> 0 AS ok FROM {_FLOW}
), d AS (SELECT doc_id, {trim_sql("string_agg(chr(10) || chr(10) || '=== Page ' || page || CASE WHEN NOT ok THEN ' (Error) ===' || chr(10) WHEN text = '' THEN ' (No Text) ===' || chr(10) ELSE ' ===' || chr(10) || text END, '' ORDER BY page)")} AS text,
 count(*) AS n, count(*) FILTER (WHERE ok AND text <> '') AS successful_pages FROM p GROUP BY doc_id)
SELECT doc_id, text, successful_pages, CASE WHEN successful_pages / n >= 0.9 AND length(text) / n > 500 THEN 'high'
 WHEN successful_pages / n >= 0.7 AND length(text) / n > 200 THEN 'medium' ELSE 'low' END AS quality FROM d""",
    "metadata_defaults": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS title,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Unknown' END AS author, '' AS subject FROM customer""",
    "extraction_fallbacks": f"""WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN nullif({trim_sql('text')}, '') END AS a, CASE WHEN n_chars < 900 THEN source END AS b FROM documents)
SELECT doc_id, coalesce(a, b, 'No text could be extracted.') AS text, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 ELSE 0 END AS attempt FROM a""",
    "plain_files": "SELECT doc_id, text FROM documents",
    "settings_migrate": """SELECT c_custkey, 1 AS version, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) ELSE 'furniture' END AS provider,
 c_name AS model FROM customer""",
    "embedding_replies": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 3 THEN -1 ELSE 1 END AS dims, CASE WHEN doc_id % 4 < 3 THEN n_chars::DOUBLE END AS first FROM documents""",
    "ingest_progress": "SELECT doc_id, round(30 + 50 * (doc_id % 7) / 7, 6) AS percent FROM documents",
    "chunk_offsets": rf"""WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents
), c AS (SELECT doc_id, chunk_index, content, list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda z: {trim_sql('z')}), lambda z: z <> '') AS ps FROM ({_PARAGRAPH_ROWS}))
SELECT doc_id, chunk_index, (instr(text, ps[len(ps)]) - 1)::INTEGER AS start_char, length(content)::INTEGER AS n FROM c JOIN t USING (doc_id)""",
    "zipped_vectors": """SELECT doc_id || '_' || i AS chunk_id, doc_id, source, c[i + 1] AS content, CASE WHEN i <= doc_id % 3 THEN 2 ELSE 0 END AS dims FROM (
 SELECT doc_id, source, string_split(text, chr(10)) AS c, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""",
    "ingest_documents": f"SELECT doc_id, doc_id || '_' || chunk_index AS chunk_id, chunk_index, content, 384 AS dims, 'plain' AS embedder FROM {_INGESTED}",
    "ingest_refused": f"SELECT doc_id, 'no text' AS problem FROM documents WHERE lang = 'fr' OR {trim_sql('text')} = ''",
    "regenerate_embeddings": "SELECT item_id, 'plain' AS embedder, item_id % 3 <> 0 AS regenerated, CASE WHEN item_id % 3 = 0 THEN 1 ELSE 384 END AS dims FROM benchmark",
    "document_checks": """WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 400) AS c FROM documents
), v AS (SELECT doc_id, len(c) AS n, CASE WHEN doc_id % 4 = 0 THEN greatest(len(c) - 1, 0) ELSE len(c) END AS m, len(list_filter(c, lambda x: length(x) % 5 = 0)) AS empty FROM c)
SELECT doc_id, CASE WHEN n = 0 THEN 'no chunks' WHEN n = m AND empty > 0 THEN 'empty embedding' ELSE '' END AS problem, n > 0 AND n <> m AS regenerate FROM v""",
    "cascade_delete": """SELECT 'documents' AS "of", doc_id FROM documents WHERE doc_id NOT IN (3, 5, 8, 144) UNION ALL SELECT 'chunks', vec_id FROM embeddings
 WHERE vec_id NOT IN (3, 5, 8, 144) UNION ALL SELECT 'labels', doc_id FROM labels WHERE doc_id NOT IN (3, 5, 8, 144)""",
    "diagnostics": """SELECT doc_id, n::INTEGER AS n_chunks, m::INTEGER AS n_embeddings, n = m AS sound, substr(text, 1, 100) || '...' AS preview, 2 AS dimension,
 doc_id || ': ' || n || ' chunks, ' || m || ' vectors, ' || CASE WHEN n = m THEN 'ok' ELSE 'broken' END AS report
 FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, least(4, len(string_split(text, chr(10)))) AS m FROM documents)""",
    "interaction_metrics": """SELECT conv_id, turn, length(text)::INTEGER AS query_length, length(text || text)::INTEGER AS response_length, len(string_split(text, ' '))::INTEGER AS source_count
 FROM conversations WHERE role = 'user'""",
    "library_totals": """SELECT sum(len(string_split(text, chr(10))))::BIGINT AS total_chunks, sum(CASE WHEN doc_id % 2 = 0 AND n_chars > 0 THEN n_chars
 WHEN doc_id % 3 = 0 AND length(text) > 0 THEN length(text) ELSE length(replace(text, chr(10), '')) END)::BIGINT AS total_size,
 floor(avg(CASE WHEN doc_id % 100 > 1 THEN (doc_id % 100) / 100 ELSE doc_id % 100 END) * 100 + 0.5)::BIGINT AS mean_confidence FROM documents""",
    "estimates": """SELECT event_id, round(least(100, avg(value / 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)), 6) AS cpu,
 round(least(100, (user_id % 7) * 10 + (event_id % 9) * 2 + 1.0), 6)::DOUBLE AS memory, CASE event_type WHEN 'error' THEN 80 WHEN 'click' THEN 20 ELSE 10 END AS load FROM events""",
    "requests_checked": f"""WITH m AS (SELECT conv_id, turn, text, ['semantic', 'keyword', 'hybrid', 'fuzzy'][(turn + conv_id) % 4 + 1] AS mode, conv_id % 2 = 0 AS vector FROM conversations
), g AS (SELECT *, vector AND mode IN ('semantic', 'hybrid') AS generated FROM m)
SELECT conv_id, turn, CASE WHEN mode = 'semantic' AND NOT generated THEN 'no embedding for semantic search' WHEN turn % 5 = 4 OR {trim_sql('text')} = '' THEN 'empty question'
 WHEN mode = 'fuzzy' THEN 'unknown mode' ELSE '' END AS problem, CASE WHEN mode = 'hybrid' AND NOT generated THEN 'keyword' ELSE mode END AS effective,
 generated AS embedding_generated FROM g""",
    "result_defaults": """SELECT vec_id + 1 AS rank, CASE WHEN vec_id % 3 > 0 THEN vec_id::VARCHAR ELSE 'result-' || vec_id END AS id,
 CASE WHEN vec_id % 5 > 0 THEN 's' || label ELSE 'Unknown Document' END AS source, CASE WHEN vec_id % 4 > 0 THEN label::VARCHAR WHEN vec_id % 3 > 0 THEN vec_id::VARCHAR END AS document,
 CASE WHEN vec_id % 2 > 0 THEN vec_id ELSE 0 END::INTEGER AS chunk_index, 'hybrid' AS search_mode, 1 - vec_id / 1024 AS score FROM embeddings""",
    "tab_badges": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations WHERE role = 'user') AS chat",
    "event_log": """SELECT user_id::VARCHAR AS session_id, event_id AS seq, 'metrics' AS event, '{"event_type":"' || event_type || '"}' AS payload FROM events
UNION ALL SELECT user_id::VARCHAR, event_id, 'error', '{"error_message":"' || CASE WHEN event_id % 2 = 0 THEN 'rate limit hit' ELSE 'API key missing' END || '","error_name":"error","error_kind":"'
 || CASE WHEN event_id % 2 = 0 THEN 'rate_limit' ELSE 'authentication' END || '"}' FROM events WHERE event_type = 'error'
UNION ALL SELECT user_id::VARCHAR, min(event_id) - 1, 'init', '{}' FROM events GROUP BY user_id UNION ALL SELECT user_id::VARCHAR, max(event_id) + 1, 'finish', '{}' FROM events GROUP BY user_id""",
    "index_append": """WITH c AS (SELECT e.vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)
SELECT vec_id::VARCHAR AS chunk_id, (SELECT 2 * count(*) FROM c)::INTEGER AS before FROM c WHERE vec_id < 50""",
    "export_library": f"""SELECT doc_id, '## ' || doc_id || '. ' || source || chr(10) || chr(10) || '- **Size:** ' || {_SIZE} || chr(10) || '- **Type:** '
 || CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'unknown' END || chr(10) || '- **Chunks:** ' || len(c) || chr(10) || chr(10) || '### Content Preview:' || chr(10) || chr(10)
 || substr(c[1], 1, 200) || '...' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS entry FROM (SELECT doc_id, source, n_chars AS n, string_split(text, chr(10)) AS c FROM documents)""",
    "export_chat_text": """SELECT conv_id, string_agg(upper(role) || ':' || chr(10) || text || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10), '' ORDER BY turn) AS plain
 FROM conversations GROUP BY conv_id""",
    "export_chat_json": """SELECT conv_id, '{"messages":[' || string_agg('{"id":' || turn || ',"role":"' || role || '","content":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS json
 FROM conversations GROUP BY conv_id""",
    "export_document_json": """SELECT doc_id, '{"document":{"doc_id":' || doc_id || ',"source":"' || source || '"' || coalesce(',"lang":"' || lang || '"', '') || '}}' AS json FROM documents""",
    "share_link": """WITH r AS (SELECT *, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, '["' || string_agg(CASE WHEN role = 'user' THEN 'U: ' ELSE 'A: ' END || substr(t, 1, 100) || CASE WHEN length(t) > 100 THEN '...' ELSE '' END, '","' ORDER BY turn) || '"]' AS held
 FROM r WHERE n <= 10 GROUP BY conv_id""",
    "scalar_formats": """SELECT o_orderkey, greatest(0, least(1, CASE WHEN k % 300 / 2 > 1 THEN k % 300 / 2 / 100 ELSE k % 300 / 2 END))::DOUBLE AS share,
 CASE WHEN k % 2 = 0 THEN 'direct' ELSE 'ocr' END AS method, CASE WHEN k % 5000 < 1000 THEN (k % 5000)::VARCHAR ELSE printf('%.1f', round(k % 5000 / 1000, 1)) || 'k' END AS label,
 strftime(o_orderdate, '%Y-%m-%d') AS day, repeat(o_orderstatus, least(200, k % 400)) || CASE WHEN k % 400 > 200 THEN '...' ELSE '' END AS preview,
 o_orderstatus || ' (chunk ' || (k % 9 + 1) || ')' AS source, o_orderstatus AS document,
 CASE WHEN k % 3000 < 1000 THEN k % 3000 || 'ms' ELSE printf('%.1f', round(k % 3000 / 1000, 1)) || 's' END AS time FROM (SELECT *, o_orderkey::BIGINT AS k FROM orders)""",
    "error_kinds": """SELECT event_id, ['authentication', 'authentication', 'model', 'model', 'rate_limit', 'network', 'password', 'corrupt', 'rate_limit', 'unknown'][event_id % 10 + 1] AS kind FROM events""",
    "prompts": """SELECT conv_id, turn, 'Context:' || chr(10) || 'c' || chr(10) || chr(10) || 'Question: ' || text AS context,
 'Review this answer.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer: a' AS critique,
 'Question: ' || text || chr(10) || chr(10) || 'Answer: a' || chr(10) || chr(10) || 'Improve: r' AS refinement,
 'You asked: "' || substr('find the summary ' || text, 1, 100) || CASE WHEN length(text) + 17 > 100 THEN '...' ELSE '' END || '"' || chr(10) || chr(10) || 'Summary requested.' AS offline
 FROM conversations WHERE role = 'user'""",
    "thinking_parts": """SELECT conv_id, turn, i::INTEGER AS nth, CASE WHEN i = 1 THEN 'thinking' ELSE 'text' END AS type, CASE i WHEN 0 THEN 'first' WHEN 1 THEN 'so ' || turn ELSE 'last' END AS content
 FROM (SELECT conv_id, turn, unnest(range(3)) AS i FROM conversations WHERE role = 'assistant')""",
    "stage_events": f"""SELECT query_id, seq, 'data: {{"stage":"' || stage || '","status":"' || status || '"}}' || chr(10) || chr(10) AS line FROM {_STAGE_ROWS}""",
    "events_parsed": f"SELECT query_id, seq, stage, status FROM {_STAGE_ROWS}",
    "stage_states": f"""WITH e AS (SELECT * FROM {_STAGE_ROWS} WHERE seq < query_id % 9
), l AS (SELECT query_id, seq // 2 AS nth, arg_max(status, seq) AS status FROM e GROUP BY ALL
), d AS (SELECT * FROM l UNION ALL SELECT query_id, nth + 1, 'in_progress' FROM l WHERE status = 'done' AND nth < 3 AND (query_id, nth + 1) NOT IN (SELECT (query_id, nth) FROM l))
SELECT query_id, ['search', 'ranking', 'context', 'answer'][nth + 1] AS stage, CASE WHEN status = 'in_progress' AND query_id % 3 = 0 THEN 'error' ELSE status END AS status FROM d""",
    "relevant_chunks": f"{_found('6')} SELECT query_id, rank, chunk_id, label, round(s, 6) AS similarity FROM f",
    "ask_simple": f"{_ANSWERED} SELECT query_id, 'Source of ' || p AS answer, n::INTEGER AS n FROM a",
    "ask_echo": f"""{_ANSWERED}, i AS (SELECT *, 'Source of ' || p AS initial, 'Source of ' || (19 + 2 + 10 + length(question) + 9 + length('Source of ' || p)) AS critique FROM a
), r AS (SELECT *, 'Source of ' || (10 + length(question) + 10 + length(initial) + 11 + length(critique)) AS answer FROM i)
SELECT query_id, {_KIND} AS kind, answer, sources, round(relevance, 6) AS relevance, critique, n::INTEGER AS n,
 round((90 + CASE WHEN n >= 3 THEN 85 ELSE 65 END + 60 + least(95, best * 100)) / 4, 6) AS rating,
 (ceil(p / 4) + ceil(length(initial) / 4) + ceil(length(critique) / 4) + ceil(length(answer) / 4))::BIGINT AS tokens FROM r""",
    "ask_nothing": "SELECT unnest([0, 7, 20])::BIGINT AS query_id, 'No documents are available. Add documents before asking.' AS answer, 0.0::DOUBLE AS relevance, 0 AS n",
}

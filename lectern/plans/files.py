"""Files in and out over the test tables: pages read apart, exports as one file each, the index scanned by ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import export as X
from lectern.sources import file_export as E
from lectern.sources import pages as P

from .observe import _SURE
from .observe import ORACLES as OBSERVE
from .tables import documents, shared_folder, table, trim_sql


def _pages_of(content: bytes):
    """Lines as pages; a file of a certain mark can't be opened."""
    text = content.decode()
    if text.startswith("x "):
        raise ValueError("not a document")
    return text.split("\n")


def _items_of(line: str):
    if len(line) % 7 == 0:
        raise KeyError("font")
    return [{"str": word, "x": i, "y": 0} for i, word in enumerate(line.split(" "))]


def _files(spark, sf_dir):
    """Documents as files; every tenth can't be opened, and every twentieth holds a text stream."""
    d = documents(spark, sf_dir)
    text = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("x stream "), "text", F.lit(" endstream"))).when(F.col("doc_id") % 10 == 0, F.lit("x")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 20 == 10, F.lit("x nothing")).otherwise(text)
    return d.select("doc_id", F.col("source").alias("name"), F.col("n_chars").alias("size"), F.encode(text, "UTF-8").alias("content"))


def pages_isolated(spark, sf_dir):
    """Documents of files of which some pages, or all, or the file itself fail."""
    docs, _ = P.read_documents(_files(spark, sf_dir), _pages_of, _items_of)
    return docs.select(
        "doc_id", "method", "pages", "successful_pages", "failed_pages", F.round("confidence", 6).alias("confidence"), F.array_join("warnings", "; ").alias("warnings"),
        F.when(F.col("method") != "Server", F.col("text")).alias("text"),
    )


def pages_quarantined(spark, sf_dir):
    """The pages that fail, and why."""
    return P.quarantine(P.read_pages(_files(spark, sf_dir).select("doc_id", "content"), _pages_of, _items_of))


def export_files(spark, sf_dir):
    """Texts and chunks of documents and pages of chats, each written as a file of its own and read back."""
    folder = shared_folder(spark, "export")
    d = documents(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", "doc_id", F.lit("a/b.PDF")).alias("name"), F.col("text").alias("content"))
    d = d.withColumn("chunks", F.split("content", "\n"))
    for format in ("txt", "chunks"):
        E.write_files(X.document_files(d, format, F.lit("2024-01-01")), folder)
    chats = X.chat_html(table(spark, sf_dir, "conversations"))
    E.write_files(chats.select(F.concat(F.lit("chat-"), F.col("conv_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content")), folder)
    return E.read_files_back(spark, folder)


def export_library_json(spark, sf_dir):
    d = documents(spark, sf_dir).select(
        "doc_id", F.col("source").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("size"), F.lit(None).cast("string").alias("type"),
        F.slice(F.split("text", "\n"), 1, 2).alias("chunks"), F.lit("Enhanced").alias("method"), (F.col("doc_id") % 100).alias("confidence"),
        F.when(F.col("doc_id") % 3 == 0, "high").alias("quality"),
    )
    j = X.library_json(d)
    held = lambda path: F.get_json_object("json", f"$.{path}")
    return j.select(
        "doc_id", held("name").alias("name"), held("size").cast("long").alias("size"), held("type").alias("type"), held("chunks[0]").alias("first"),
        held("processingStats.confidence").cast("long").alias("confidence"), held("processingStats.quality").alias("quality"),
    )


_LINES = f"""l AS (SELECT doc_id, source, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents
 WHERE doc_id % 10 <> 0), p AS (SELECT *, length(line) % 7 = 0 AS bad, {trim_sql("regexp_replace(line, '\\s+', ' ', 'g')")} AS t FROM l)"""
_TROUBLE = "'ValueError: not a document'"
#: Bytes of the text between marks that the server's way finds in a plain text.
_MARKED = r"""octet_length(encode(array_to_string(list_filter(list_transform(regexp_extract_all(text, '\$\$[^)]+\$\$'), lambda m: substr(m, 2, length(m) - 2)),
 lambda m: length(m) > 2 AND regexp_matches(m, '[a-zA-Z]')), ' ')))"""

QUERIES = {f.__name__: f for f in (pages_isolated, pages_quarantined, export_files, export_library_json)}
ORACLES = {
    "pages_isolated": f"""WITH {_LINES}, g AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (NOT bad AND t <> '') AS good, count(*) FILTER (bad OR t = '') AS failed,
 avg({_SURE}) FILTER (NOT bad AND t <> '') AS confidence, min(page) FILTER (bad) AS first_bad,
 {trim_sql("string_agg(chr(10) || chr(10) || '=== Page ' || page || CASE WHEN bad THEN ' (Error) ===' || chr(10) WHEN t = '' THEN ' (No Content) ===' || chr(10) ELSE ' ===' || chr(10) || t END, '' ORDER BY page)")} AS text
 FROM p GROUP BY doc_id), s AS ({OBSERVE['server_extract']}), a AS (
SELECT d.doc_id, d.source, d.n_chars, g.*, CASE WHEN g.good > 0 THEN 'Enhanced' WHEN d.doc_id % 20 = 0 AND s.n >= 50 OR d.doc_id % 10 <> 0 AND {_MARKED.replace('text', 'd.text')} >= {P.LEAST_SERVER_TEXT} THEN 'Server' ELSE 'Enhanced Fallback' END AS method,
 CASE WHEN d.doc_id % 10 = 0 THEN {_TROUBLE} WHEN first_bad IS NOT NULL THEN 'KeyError: ''font''' ELSE 'Unknown error' END AS problem
 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, method, CASE WHEN method = 'Enhanced' THEN pages ELSE 1 END AS pages, CASE method WHEN 'Enhanced' THEN good WHEN 'Server' THEN 1 ELSE 0 END AS successful_pages,
 CASE method WHEN 'Enhanced' THEN failed WHEN 'Server' THEN 0 ELSE 1 END AS failed_pages, CASE method WHEN 'Enhanced' THEN round(confidence, 6) WHEN 'Server' THEN NULL ELSE 0.0 END AS confidence,
 CASE method WHEN 'Enhanced' THEN CASE WHEN failed > 0 THEN failed || ' pages failed to process' ELSE '' END WHEN 'Server' THEN ''
  ELSE 'PDF processing failed; ' || problem || '; Using structured fallback content' END AS warnings,
 CASE method WHEN 'Enhanced' THEN text WHEN 'Server' THEN NULL ELSE '# PDF Processing Report: ' || source || chr(10) || chr(10) || '## Processing Status: FAILED' || chr(10) || chr(10)
  || '**Error**: ' || problem || chr(10) || '**File Size**: ' || printf('%.2f', n_chars / (1024 * 1024)) || ' MB' || chr(10) END AS text FROM a""",
    "pages_quarantined": f"""WITH {_LINES} SELECT doc_id, page::INTEGER AS page, 'KeyError: ''font''' AS problem FROM p WHERE bad
UNION ALL SELECT doc_id, 0, {_TROUBLE} FROM documents WHERE doc_id % 10 = 0""",
    "export_files": f"""WITH d AS (SELECT source || '-' || doc_id || '-a' AS stem, source || '-' || doc_id || '-a/b.PDF' AS name, text, string_split(text, chr(10)) AS c FROM documents)
SELECT stem || '_b_extracted.txt' AS name, text AS content FROM d
UNION ALL SELECT stem || '_b_chunks.md', '# Document Chunks: ' || name || chr(10) || chr(10) || 'Exported: 2024-01-01' || chr(10) || 'Total Chunks: ' || len(c)
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || array_to_string(list_transform(c, lambda x, i: '## Chunk ' || i || chr(10) || chr(10) || x
 || chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') FROM d
UNION ALL SELECT 'chat-' || conv_id || '.html', '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><title>Chat Export</title></head>' || chr(10) || '<body>' || chr(10)
 || '<h1>Chat Export</h1>' || chr(10) || string_agg('<div class="message ' || role || '"><h3>' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || '</h3><p>'
 || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p></div>' || chr(10), '' ORDER BY turn) || '</body>' || chr(10) || '</html>' || chr(10)
 FROM conversations GROUP BY conv_id""",
    "export_library_json": """SELECT doc_id, source AS name, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS size, 'unknown' AS type, string_split(text, chr(10))[1] AS first,
 doc_id % 100 AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'unknown' END AS quality FROM documents""",
}

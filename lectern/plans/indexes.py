"""Indexes over the test tables: nearest chunks by cells, keywords by postings, scans by ids and filters, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.similarity import cosine_strict
from lectern.operators import search as S
from lectern.operators.ask import find_relevant_chunks
from lectern.operators.filters import Filters
from lectern.operators.index import ChunkIndex
from lectern.operators.keyword_index import KeywordIndex
from lectern.operators.vector_index import VectorIndex

from .library import _ASKED, _found
from .search import _MIXED, _PAIRS, QUESTIONS, _hits
from .search import ORACLES as SEARCH
from .tables import CHUNKS_SQL, chunks, documents, keyword_sql, shared_folder, table, vector_queries


def vector_index_topk(spark, sf_dir):
    """``multi_query_topk`` from an index of cells."""
    index = VectorIndex(spark, shared_folder(spark, "vectors"))
    index.build(chunks(spark, sf_dir))
    return _hits(index.search(vector_queries(spark, sf_dir, QUESTIONS), 10, 0.1))


#: Words that a part of the texts has, whole, in other words, or around words of theirs.
_ASKED_WORDS = {1: "oneding hatish", 2: "verheit", 3: "!!!", 4: "schtzkeiten x"}


def keyword_index_topk(spark, sf_dir):
    """Twenty best documents of some questions, from postings and grams; texts of candidates only are scored."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index = KeywordIndex(spark, shared_folder(spark, "keywords"))
    index.build(docs)
    asked = spark.createDataFrame(list(_ASKED_WORDS.items()), "query_id long, question string")
    return _hits(index.search(asked, docs, 20).withColumn("score", F.round("score", 6)))


def _index(spark, sf_dir, **options):
    index = ChunkIndex(spark, shared_folder(spark, "index"), **options)
    index.create()
    return index


def index_scan_ids(spark, sf_dir):
    """Rows of an index by chunk ids and chunk numbers; only the partitions of the ids are read."""
    index = _index(spark, sf_dir, dimension=64)
    index.upsert(chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string")))
    found = index.scan({"chunk_id": {"$in": [str(i) for i in range(0, 200, 9)]}, "chunk_index": {"$lt": 150}})
    return found.select("chunk_id", "doc_id", "chunk_index")


def index_long_texts(spark, sf_dir):
    """Texts of up to some 100,000 characters in an index as they are, and in one that cuts them."""
    rows = documents(spark, sf_dir).where("n_chars > 100").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    whole, cut = _index(spark, sf_dir), _index(spark, sf_dir, content_chars=40_000)
    rows = whole.dealt(rows).withColumn("content", F.repeat("text", F.lit(25)))
    whole.append(rows, dealt=True)
    cut.append(rows, dealt=True)
    named = lambda index, name: index.scan().select("chunk_id", F.length("content").alias(name))
    return named(whole, "whole").join(named(cut, "cut"), "chunk_id")


def index_check(spark, sf_dir):
    """State of an index that holds vectors of two lengths."""
    index = _index(spark, sf_dir, dimension=64)
    rows = chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    index.append(rows.withColumn("embedding", F.when(F.col("chunk_index") % 4 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))))
    return ChunkIndex(spark, index.path).check()


def _candidates(backend):
    def query(spark, sf_dir):
        return _hits(S.two_stage_search(vector_queries(spark, sf_dir, QUESTIONS), chunks(spark, sf_dir), backend, 3))

    query.__doc__ = f"Three hits for each question among the candidates that a {backend} index would be asked for."
    return query


def _described(spark, sf_dir):
    """Chunks with the author, tags and date of their document."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "author", "tags", F.expr("date_add(date'2024-01-01', cast(doc_id % 365 as int))").cast("timestamp").alias("date"))
    return chunks(spark, sf_dir).join(d, "chunk_id")


_FILTERS = {"authors": ["SRC3", "src7", "src1", "src12", "src5"], "date_from": "2024-01-10", "date_to": "2024-11-30"}


def _filtered_search(profile):
    def query(spark, sf_dir):
        found = S.search(vector_queries(spark, sf_dir, QUESTIONS), _described(spark, sf_dir), "hybrid", profile, Filters(**_FILTERS), ties=("chunk_id",))
        return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.date_format("date", "yyyy-MM-dd").alias("day"))

    query.__doc__ = f"Hybrid search of the {profile} profile among chunks of some authors and dates."
    return query


def relevant_filtered(spark, sf_dir):
    """The diverse best chunks of each question among those of two languages."""
    found = find_relevant_chunks(vector_queries(spark, sf_dir, _ASKED), _described(spark, sf_dir), 6, Filters(tags=["en", "fr"], min_similarity=0.05))
    return found.select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"))


def relevant_dimensions(spark, sf_dir):
    """Every third chunk has a vector of another length: it is passed over, though the bound is below 0."""
    c = chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("chunk_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    found = find_relevant_chunks(vector_queries(spark, sf_dir, {7: "a", 20: "b"}), c, None, Filters(min_similarity=-1.0))
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


def strict_cosine(spark, sf_dir):
    """Cosine of each vector with the next, in the form that raises on other lengths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine_strict("embedding", "next"), 6).alias("score"))


_WORDS_SQL = " UNION ALL ".join(f"SELECT {k} AS query_id, '{v}' AS question" for k, v in _ASKED_WORDS.items())
_DESCRIBED = CHUNKS_SQL.replace("SELECT e.vec_id", "SELECT d.source AS author, DATE '2024-01-01' + (d.doc_id % 365)::INTEGER AS day, d.lang, e.vec_id")
_WHERE = "lower(author) IN ('src3', 'src7', 'src1', 'src12', 'src5') AND day BETWEEN DATE '2024-01-10' AND DATE '2024-11-30'"


def _two_stage_sql(backend: str, near: int, worded: int | None) -> str:
    parts = "s, k FROM n WHERE by_s <= {near}" if worded is None else (
        "CASE WHEN by_s <= {near} THEN s ELSE 0 END AS s, CASE WHEN by_k <= {worded} AND k > 0 THEN k ELSE 0 END AS k FROM n WHERE by_s <= {near} OR by_k <= {worded} AND k > 0"
    )
    return f"""{_PAIRS}, k AS (SELECT *, {keyword_sql('question', 'content')} AS k FROM p
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS by_s, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, chunk_id) AS by_k FROM k
), parts AS (SELECT query_id, chunk_id, {parts.format(near=near, worded=worded)}
), m AS (SELECT query_id, chunk_id, round({_MIXED[backend]}, 6) AS score FROM parts
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score >= 0.05)
SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 3"""


def _filtered_sql(profile: str) -> str:
    pairs = _PAIRS.replace(CHUNKS_SQL, f"SELECT * FROM ({_DESCRIBED}) WHERE {_WHERE}")
    return f"""{pairs}, k AS (SELECT *, {keyword_sql('question', 'content')} AS k FROM p
), m AS (SELECT query_id, chunk_id, day, {_MIXED[profile]} AS score FROM k
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score >= 0.05)
SELECT query_id, rank, chunk_id, round(score, 6) AS score, strftime(day, '%Y-%m-%d') AS day FROM r WHERE rank <= 10"""


QUERIES = {
    f.__name__: f
    for f in (vector_index_topk, keyword_index_topk, index_scan_ids, index_long_texts, index_check, relevant_filtered, relevant_dimensions, strict_cosine)
} | {f"candidates_{b}": _candidates(b) for b in ("pinecone", "chroma")} | {f"filtered_{p}": _filtered_search(p) for p in _MIXED}
ORACLES = {
    "vector_index_topk": SEARCH["multi_query_topk"],
    "keyword_index_topk": f"""WITH s AS (SELECT query_id, doc_id AS chunk_id, round({keyword_sql('question', 'text')}, 6) AS score FROM documents, ({_WORDS_SQL})
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 20""",
    "index_scan_ids": f"""SELECT chunk_id::VARCHAR AS chunk_id, doc_id, chunk_index FROM ({CHUNKS_SQL}) WHERE chunk_id < 200 AND chunk_id % 9 = 0 AND chunk_index < 150""",
    "index_long_texts": "SELECT doc_id::VARCHAR AS chunk_id, 25 * length(text) AS whole, least(40000, 25 * length(text)) AS cut FROM documents WHERE n_chars > 100",
    "index_check": f"SELECT true AS exists, count(*) AS rows, count(DISTINCT doc_id) AS documents, count(*) FILTER (chunk_index % 4 <> 0) AS fitting FROM ({CHUNKS_SQL})",
    "relevant_filtered": f"""{_found('6').replace(CHUNKS_SQL, f"SELECT * FROM ({_DESCRIBED}) WHERE lang IN ('en', 'fr')")} SELECT query_id, rank, chunk_id, round(s, 6) AS similarity FROM f""",
    "relevant_dimensions": f"""WITH c AS ({CHUNKS_SQL}) SELECT q.vec_id AS query_id, chunk_id, round(list_cosine_similarity(v, q.embedding::DOUBLE[]), 6) AS similarity
 FROM c, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (7, 20)) q WHERE chunk_id % 3 <> 0""",
    "strict_cosine": """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "candidates_pinecone": _two_stage_sql("pinecone", 15, None),
    "candidates_chroma": _two_stage_sql("chroma", 15, 30),
    **{f"filtered_{p}": _filtered_sql(p) for p in _MIXED},
}

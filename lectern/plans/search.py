"""Search queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.similarity import cosine
from lectern.functions.text import keyword_score
from lectern.operators import search as S
from lectern.operators.filters import Filters, compile_filter, document_filter

from .tables import CHUNKS_SQL, chunks, chunks_apart, documents, keyword_sql, norm_sql, table, vector_queries

QUESTIONS = {0: "the ation of", 7: "hehe", 20: "is the ingeser", 33: "queau le de", 41: "!!!"}
KEYWORDS = "the ation of hehe"


def _scored(spark, sf_dir, vec_id: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", "label", cosine("embedding", "q").alias("score"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0."""
    top = _scored(spark, sf_dir, 0).where("score >= 0.05").orderBy(F.desc("score"), "vec_id").limit(10)
    return top.select("vec_id", F.round("score", 6).alias("score"))


def cosine_threshold(spark, sf_dir):
    """All vectors at least 0.1 similar to vector 0."""
    return _scored(spark, sf_dir, 0).where("score >= 0.1").select("vec_id", F.round("score", 6).alias("score"))


def cosine_dim_guard(spark, sf_dir):
    """Vectors of another length score 0: every vector against the first half of vector 0."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.slice("embedding", 1, 32).alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", cosine("embedding", "q").alias("score"))


def browser_topk(spark, sf_dir):
    """Five nearest, without a threshold."""
    top = _scored(spark, sf_dir, 3).orderBy(F.desc("score"), "vec_id").limit(5)
    return top.select("vec_id", F.round("score", 6).alias("score"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def multi_query_topk(spark, sf_dir):
    """Several queries in one job, ten hits each."""
    found = S.search(vector_queries(spark, sf_dir, QUESTIONS), chunks(spark, sf_dir), "semantic", "local", threshold=0.1, ties=("chunk_id",))
    return _hits(found)


def diverse_topk(spark, sf_dir):
    """Best chunk of each label first, then the best of the rest."""
    scored = S.with_scores(vector_queries(spark, sf_dir, QUESTIONS), chunks(spark, sf_dir)).where("semantic >= 0.05")
    rounded = scored.withColumn("similarity", F.round("semantic", 6))
    top = S.diverse_top_k(rounded, 8, source="source", ties=("chunk_id",))
    return top.select("query_id", "rank", "chunk_id", "source", "similarity")


def keyword_search(spark, sf_dir):
    """Keyword scores of every document that has any, for one question."""
    d = documents(spark, sf_dir).withColumn("score", keyword_score(F.lit(KEYWORDS), "text"))
    return d.where("score > 0").select("doc_id", F.round("score", 6).alias("score"))


def keyword_empty_query(spark, sf_dir):
    """A question without words scores every document 0, and local keyword search admits that."""
    d = documents(spark, sf_dir).withColumn("score", keyword_score(F.lit("!!!"), "text"))
    return d.where(F.col("score") >= F.lit(S.threshold_of("local", "keyword", 0))).select("doc_id", "score")


def _hybrid(profile):
    def query(spark, sf_dir):
        q = vector_queries(spark, sf_dir, QUESTIONS)
        scored = S.with_scores(q, chunks(spark, sf_dir), profile)
        scored = scored.withColumn("score", F.round(S.mixed_score(profile, F.col("semantic"), F.col("keyword")), 6))
        scored = scored.where(F.col("score") >= S.threshold_of(profile, "hybrid", None))
        return _hits(S.top_k(scored, 10))

    query.__doc__ = f"Ten hits for each question by meaning and keywords, mixed as {profile} does."
    return query


def weaviate_rank(spark, sf_dir):
    """Scores that follow the rank, not the similarity."""
    q, c = vector_queries(spark, sf_dir, QUESTIONS), chunks(spark, sf_dir)
    return _hits(S.search(q, c, "semantic", "weaviate", threshold=0.05, ties=("chunk_id",)))


def weaviate_keyword(spark, sf_dir):
    """Hits by BM25, shown with their keyword scores."""
    q, (c, texts) = vector_queries(spark, sf_dir, QUESTIONS), chunks_apart(spark, sf_dir)
    return _hits(S.search(q, c, "keyword", "weaviate", ties=("chunk_id",), texts=texts))


def weaviate_hybrid(spark, sf_dir):
    """BM25 and semantic rankings fused; scores follow the fused rank."""
    q, (c, texts) = vector_queries(spark, sf_dir, QUESTIONS), chunks_apart(spark, sf_dir)
    return _hits(S.search(q, c, "hybrid", "weaviate", threshold=0.2, ties=("chunk_id",), texts=texts))


def hybrid_merge(spark, sf_dir):
    """Semantic hits and keyword hits of one question merged by chunk."""
    s = _scored(spark, sf_dir, 0).where("score >= 0.1").select(F.col("vec_id").alias("chunk_id"), "score")
    k = keyword_search(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "score")
    merged = S.merge_hybrid(s, k, "chunk_id", "chroma")
    return merged.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic_score", "keyword_score", "score")])


def _filtered(**options):
    def query(spark, sf_dir):
        d = documents(spark, sf_dir).withColumn("date", F.lit(None).cast("timestamp"))
        return d.where(document_filter(Filters(**options))).select("doc_id", "author", "lang")

    query.__doc__ = f"Documents by {', '.join(options)}."
    return query


def filter_date(spark, sf_dir):
    """Orders in a range of dates, both ends included."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate"))
    f = Filters(date_from="1996-01-01 00:00:00", date_to="1996-12-31 00:00:00")
    return o.where(document_filter(f)).select("o_orderkey", "o_totalprice")


def filter_dsl(spark, sf_dir):
    """The dictionary form of filters."""
    spec = {"author": {"$in": ["src1", "src2"]}, "lang": "en", "n_chars": {"$gte": 100, "$lte": 5000}}
    return documents(spark, sf_dir).where(compile_filter(spec)).select("doc_id", "author", "n_chars")


_QUESTIONS_SQL = " UNION ALL ".join(f"SELECT {k} AS query_id, '{v}' AS question" for k, v in QUESTIONS.items())
_PAIRS = f"""
WITH c AS ({CHUNKS_SQL}), q AS (SELECT x.query_id, x.question, e.embedding::DOUBLE[] AS qv FROM ({_QUESTIONS_SQL}) x JOIN embeddings e ON e.vec_id = x.query_id
), p AS (SELECT *, list_cosine_similarity(v, qv) AS s FROM c, q)"""
_BM25 = f"""{_PAIRS}, w AS (SELECT chunk_id, list_filter(string_split({norm_sql('content')}, ' '), lambda w: w <> '') AS w FROM c
), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w
), t AS (SELECT chunk_id, len(w) AS length, unnest(w) AS word FROM w
), tf AS (SELECT chunk_id, length, word, count(*) AS tf FROM t GROUP BY ALL
), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word
), a AS (SELECT query_id, unnest(list_distinct(list_filter(string_split({norm_sql('question')}, ' '), lambda w: w <> ''))) AS word FROM q
), b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS bm25
 FROM a JOIN tf USING (word) JOIN df USING (word), n GROUP BY ALL)"""
_ONE = "SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {}) q"
_MIXED = {
    "local": "CASE WHEN s > 0 AND k > 0 THEN (s + k) / 2 WHEN s > 0 THEN s ELSE k END",
    "pinecone": "0.6 * s + 0.4 * k",
    "chroma": "CASE WHEN s > 0 AND k > 0 THEN 0.6 * s + 0.4 * k ELSE s + k END",
}


def _hybrid_sql(profile):
    return f"""{_PAIRS}, k AS (SELECT *, {keyword_sql('question', 'content')} AS k FROM p
), m AS (SELECT query_id, chunk_id, doc_id, chunk_index, round({_MIXED[profile]}, 6) AS score FROM k
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m WHERE score >= 0.05)
SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10"""


QUERIES = {
    "cosine_topk": cosine_topk,
    "cosine_threshold": cosine_threshold,
    "cosine_dim_guard": cosine_dim_guard,
    "browser_topk": browser_topk,
    "multi_query_topk": multi_query_topk,
    "diverse_topk": diverse_topk,
    "keyword_search": keyword_search,
    "keyword_empty_query": keyword_empty_query,
    "hybrid_local": _hybrid("local"),
    "hybrid_pinecone": _hybrid("pinecone"),
    "hybrid_chroma": _hybrid("chroma"),
    "hybrid_merge": hybrid_merge,
    "weaviate_rank": weaviate_rank,
    "weaviate_keyword": weaviate_keyword,
    "weaviate_hybrid": weaviate_hybrid,
    "filter_ids": _filtered(document_ids=[1, 5, 8, 13, 21]),
    "filter_author": _filtered(authors=["SRC3", "src7"]),
    "filter_tags": _filtered(tags=["fr", "es"]),
    "filter_date": filter_date,
    "filter_dsl": filter_dsl,
}
ORACLES = {
    "cosine_topk": f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE.format(0)}) WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 10",
    "cosine_threshold": f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE.format(0)}) WHERE s >= 0.1",
    "cosine_dim_guard": "SELECT vec_id, 0.0::DOUBLE AS score FROM embeddings",
    "browser_topk": f"SELECT vec_id, round(s, 6) AS score FROM ({_ONE.format(3)}) ORDER BY s DESC, vec_id LIMIT 5",
    "multi_query_topk": f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM p WHERE s >= 0.1)
SELECT query_id, rank, chunk_id, round(s, 6) AS score FROM r WHERE rank <= 10""",
    "diverse_topk": f"""{_PAIRS}, r AS (SELECT query_id, chunk_id, source, round(s, 6) AS similarity FROM p WHERE s >= 0.05
), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY similarity DESC, chunk_id) AS nth FROM r
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, similarity DESC, chunk_id) AS rank FROM n)
SELECT query_id, rank, chunk_id, source, similarity FROM o WHERE rank <= 8""",
    "keyword_search": f"SELECT * FROM (SELECT doc_id, round({keyword_sql(repr(KEYWORDS), 'text')}, 6) AS score FROM documents) WHERE score > 0",
    "keyword_empty_query": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents",
    **{f"hybrid_{p}": _hybrid_sql(p) for p in _MIXED},
    "hybrid_merge": f"""
WITH s AS (SELECT vec_id, s FROM ({_ONE.format(0)}) WHERE s >= 0.1
), k AS (SELECT doc_id, round({keyword_sql(repr(KEYWORDS), 'text')}, 6) AS k FROM documents
), m AS (SELECT coalesce(vec_id, doc_id) AS chunk_id, coalesce(s, 0) AS s, coalesce(k, 0) AS k FROM s FULL JOIN (SELECT * FROM k WHERE k > 0) ON vec_id = doc_id)
SELECT chunk_id, round(s, 6) AS semantic_score, round(k, 6) AS keyword_score, round({_MIXED['chroma']}, 6) AS score FROM m""",
    "weaviate_rank": f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM p WHERE s >= 0.05)
SELECT query_id, rank, chunk_id, round(greatest(0.5, 1 - (rank - 1) / 10), 6) AS score FROM r WHERE rank <= 10""",
    "weaviate_keyword": f"""{_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM b)
SELECT r.query_id, rank, r.chunk_id, round({keyword_sql('p.question', 'p.content')}, 6) AS score FROM r JOIN p USING (query_id, chunk_id) WHERE rank <= 10""",
    "weaviate_hybrid": f"""{_BM25}, e AS (SELECT query_id, chunk_id, CASE WHEN s >= 0.2 THEN round(s, 9) END AS s, bm25 FROM p LEFT JOIN b USING (query_id, chunk_id)
), x AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE 0.75 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, chunk_id)) END
 + CASE WHEN bm25 IS NULL THEN 0 ELSE 0.25 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC NULLS LAST, chunk_id)) END AS f
 FROM e WHERE s IS NOT NULL OR bm25 IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, chunk_id) AS rank FROM x)
SELECT query_id, rank, chunk_id, round(greatest(0.3, 1 - (rank - 1) / 10), 6) AS score FROM r WHERE rank <= 10""",
    "filter_ids": "SELECT doc_id, source AS author, lang FROM documents WHERE doc_id IN (1, 5, 8, 13, 21)",
    "filter_author": "SELECT doc_id, source AS author, lang FROM documents WHERE lower(source) IN ('src3', 'src7')",
    "filter_tags": "SELECT doc_id, source AS author, lang FROM documents WHERE lang IN ('fr', 'es')",
    "filter_date": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'",
    "filter_dsl": "SELECT doc_id, source AS author, n_chars FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND n_chars BETWEEN 100 AND 5000",
}

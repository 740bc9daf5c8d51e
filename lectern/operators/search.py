"""Search: queries against chunks by meaning, by keywords, or both.

Queries are a DataFrame too, so a batch of questions is one job. They are broadcast if there are at
most ``BROADCAST_QUERIES`` of them; beyond that Spark picks the join. Scores are computed on the chunk side with
the query's normal form and norm computed once; ranking keeps ``k`` rows for each query before any
shuffle (window group limit).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.similarity import cosine_of, dot, norm
from lectern.functions.text import keyword_form, keyword_score, keyword_score_of, source_document

from .filters import Filters, document_filter
from .requests import candidate_limit

BROADCAST_QUERIES = 1_000
BROADCAST_WORDS = 100_000
#: Reciprocal rank fusion: what is added to ranks, and the semantic ranking's share.
FUSION_OFFSET, SEMANTIC_SHARE = 60, 0.75


@dataclass(frozen=True)
class Profile:
    """How a backend scores: thresholds by mode, weights of the mixture, its treatment of empty text."""

    semantic: float | None
    keyword: float
    hybrid: float
    empty_is_zero: bool = True


# Score thresholds of the four backends.
PROFILES = {
    "local": Profile(0.1, 0.0, 0.05, empty_is_zero=False),
    "pinecone": Profile(None, 0.01, 0.05),
    "chroma": Profile(None, 0.01, 0.05),
    "weaviate": Profile(0.7, 0.0, 0.0),
}


def threshold_of(profile: str, mode: str, asked: float | None) -> float | None:
    """The score a result needs. An explicit 0 means the default, except for local keyword search."""
    default = getattr(PROFILES[profile], mode)
    if profile == "local" and mode == "keyword":
        return default if asked is None else asked
    return asked or default


def mixed_score(profile: str, semantic: Column, keyword: Column, has_vector: Column | None = None) -> Column:
    """One score from two, as each backend mixes them."""
    both = (semantic > 0) & (keyword > 0)
    if profile == "local":
        return F.when(both, (semantic + keyword) / 2).when(semantic > 0, semantic).otherwise(keyword)
    weighted = 0.6 * semantic + 0.4 * keyword
    if profile == "pinecone":
        return F.when(F.lit(True) if has_vector is None else has_vector, weighted).otherwise(keyword)
    if profile == "chroma":
        return F.when(both, weighted).otherwise(semantic + keyword)
    raise ValueError(f"{profile} has no mixture")


def few(df: DataFrame, rows: int = BROADCAST_QUERIES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_scores(queries: DataFrame, chunks: DataFrame, keyword: str | None = None, strict: bool = False) -> DataFrame:
    """Every query and chunk with its ``semantic`` score, and with a profile's name also ``keyword``; null where inputs are missing.

    ``queries``: query_id, question, embedding. ``chunks``: chunk_id, content, embedding and more. Norms and keyword forms are
    computed once for each query and each chunk, before they meet. Vectors of another length score 0, or null if ``strict``.
    """
    asked = queries.select("query_id", "question", F.col("embedding").alias("q_vector"), norm("embedding").alias("q_norm"))
    held = chunks.withColumn("c_norm", norm("embedding"))
    if keyword:
        asked = asked.withColumn("q_words", keyword_form("question", True))
        held = held.withColumn("c_words", keyword_form("content"))
    pairs = held.crossJoin(few(asked))
    if keyword:
        pairs = pairs.withColumn("keyword", keyword_score_of("q_words", "c_words", PROFILES[keyword].empty_is_zero)).drop("q_words", "c_words")
    same = F.size("q_vector") == F.size("embedding")
    semantic = F.when(same, cosine_of(dot("q_vector", "embedding"), F.col("q_norm"), F.col("c_norm")))
    if not strict:
        semantic = semantic.when(F.col("q_vector").isNotNull() & F.col("embedding").isNotNull(), 0.0)
    return pairs.withColumn("semantic", semantic).drop("q_norm", "c_norm", "q_vector")


def top_k(scored: DataFrame, k, score: str = "score", by: str | None = "query_id", ties=("chunk_id",)) -> DataFrame:
    """The ``k`` best rows of each query as ``rank``; ties in the order of ``ties``. ``k`` may be a column."""
    window = W.partitionBy(by) if by else W.partitionBy()
    ranked = scored.withColumn("rank", F.row_number().over(window.orderBy(F.desc(score), *ties)))
    return ranked.where(F.col("rank") <= k)


def bm25(queries: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, texts: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``bm25`` of every chunk that shares a word with a query; a word asked twice counts once.

    Only words that some query asks for leave the text side, counted before the shuffle; where ``texts`` (chunk_id, content) are held
    apart from chunks, these meet counts and lengths, not texts. Scores are rounded to nine places, so that ties don't hang on the order of sums.
    """
    forms = (chunks if texts is None else texts).select("chunk_id", keyword_form("content", True)["words"].alias("words"))
    of_chunks = lambda rows: rows if texts is None else rows.join(chunks.select("chunk_id"), "chunk_id")
    forms = forms.withColumn("length", F.coalesce(F.size("words"), F.lit(0)))
    n, mean = of_chunks(forms.select("chunk_id", "length")).agg(F.count("*"), F.avg("length")).first()
    asked = queries.select("query_id", F.explode(F.array_distinct(keyword_form("question", True)["words"])).alias("word"))
    # counted before words meet their frequencies, for which all texts are read
    small = F.broadcast if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else (lambda df: df)
    # not ``explode``: Spark puts filters on the array before that, for which each text is cut again
    posts = forms.select("chunk_id", "length", F.explode_outer("words").alias("word")).where("word is not null")
    posts = posts.join(small(asked.select("word").distinct()), "word", "left_semi").groupBy("word", "chunk_id", "length").agg(F.count("*").alias("tf"))
    if texts is not None:
        posts = of_chunks(posts).groupBy("word", "chunk_id", "length").agg(F.sum("tf").alias("tf"))
    spread = posts.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(spread, "word").select("query_id", "word", idf.alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0)))
    return posts.join(small(asked), "word").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 9).alias("bm25"))


def rank_in_parts(scored: DataFrame, score: str, name: str, step: float, by: str = "query_id", ties=("chunk_id",)) -> DataFrame:
    """``scored`` with the place of each row in its query's order as ``name``.

    Scores are cut in spans of ``step``; rows are ordered within a span, and only the spans' counts by query, so no task has all rows of a query.
    """
    placed = scored.withColumn("_span", F.floor(F.col(score) / step))
    above = W.partitionBy(by).orderBy(F.desc("_span")).rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(by, "_span").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    within = W.partitionBy(by, "_span").orderBy(F.desc(score), *ties)
    return placed.join(counts, [by, "_span"]).withColumn(name, F.col("_above") + F.row_number().over(within)).drop("_span", "_above")


def fused(near: DataFrame, worded: DataFrame, ties=("chunk_id",)) -> DataFrame:
    """Two rankings, by ``semantic`` and by ``bm25``, as one ``score`` by reciprocal ranks; a chunk may be in one of them only."""
    keys = list(dict.fromkeys(["query_id", "chunk_id", *ties]))
    a = rank_in_parts(near, "semantic", "_near", 0.001, ties=ties).select(*keys, "semantic", "_near")
    b = rank_in_parts(worded, "bm25", "_worded", 0.01, ties=ties).select(*keys, "bm25", "_worded")
    part = lambda place, share: F.coalesce(share / (FUSION_OFFSET + F.col(place)), F.lit(0.0))
    joined = a.join(b, keys, "full_outer")
    return joined.withColumn("score", part("_near", SEMANTIC_SHARE) + part("_worded", 1 - SEMANTIC_SHARE)).drop("_near", "_worded")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    mode: str = "hybrid",
    profile: str = "local",
    filters: Filters | None = None,
    limit: int = 10,
    threshold: float | None = None,
    ties=("doc_id", "chunk_index"),
    texts: DataFrame | None = None,
) -> DataFrame:
    """Ranked chunks for each query: ``query_id``, ``rank``, ``score``, both part scores, chunk columns.

    ``texts`` (chunk_id, content) may be held apart from chunks; a chunk without a text then takes no part.

    The ``weaviate`` profile ranks keyword search by BM25 and shows the keyword score of each hit, not sorted again;
    its hybrid search fuses BM25 with the semantic ranking above the threshold.
    """
    if filters is not None:
        chunks = chunks.where(document_filter(filters))
    if profile == "weaviate" and mode != "semantic":
        return _search_by_words(queries, chunks, mode, limit or 10, threshold, ties, texts)
    if texts is not None:
        chunks = chunks.join(texts, "chunk_id")
    scored = with_scores(queries, chunks, None if mode == "semantic" else profile)
    if mode == "semantic":
        scored = scored.where("semantic is not null").withColumn("score", F.col("semantic"))
    elif mode == "keyword":
        scored = scored.withColumn("score", F.col("keyword"))
    else:
        semantic = F.coalesce(F.col("semantic"), F.lit(0.0))
        scored = scored.withColumn("score", mixed_score(profile, semantic, F.col("keyword"), F.col("semantic").isNotNull()))
    least = threshold_of(profile, mode, threshold)
    if least is not None:
        scored = scored.where(~F.isnan("score") & (F.col("score") >= least))
    ranked = top_k(scored, limit or 10, ties=ties)
    return _ranked_score(ranked, 0.5, limit or 10) if profile == "weaviate" else ranked


def _ranked_score(ranked: DataFrame, floor: float, limit: int) -> DataFrame:
    return ranked.withColumn("score", F.greatest(F.lit(floor), 1 - (F.col("rank") - 1) / F.lit(limit)))


def _search_by_words(queries: DataFrame, chunks: DataFrame, mode: str, limit: int, threshold: float | None, ties, texts: DataFrame | None = None) -> DataFrame:
    """Texts and keyword scores are met by hits only, after ranking."""
    keys = list(dict.fromkeys(["chunk_id", *ties]))
    worded = bm25(queries, chunks, texts=texts)
    if len(keys) > 1:
        worded = worded.join(chunks.select(*keys), "chunk_id")
    if mode == "keyword":
        best = top_k(worded, limit, "bm25", ties=ties).select("query_id", "chunk_id", "rank", "bm25")
    else:
        near = with_scores(queries, chunks.select(*keys, "embedding"))
        near = near.where(F.col("semantic") >= (threshold or PROFILES["weaviate"].semantic)).select("query_id", *keys, F.round("semantic", 9).alias("semantic"))
        if texts is not None:
            near = near.join(texts.select("chunk_id"), "chunk_id").select(*near.columns)
        best = top_k(fused(near, worded, ties), limit, ties=ties).select("query_id", "chunk_id", "rank", "semantic", "bm25", "score")
    # a few hits go to the texts, not the texts to them
    small = F.broadcast if limit <= BROADCAST_WORDS // BROADCAST_QUERIES and queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else (lambda df: df)
    scored = small(best).join(chunks, "chunk_id")
    if texts is not None:
        scored = small(scored).join(texts, "chunk_id")
    scored = scored.join(few(queries.select("query_id", "question")), "query_id")
    scored = scored.withColumn("keyword", keyword_score("question", "content", empty_is_zero=True)).drop("question")
    return scored.withColumn("score", F.col("keyword")) if mode == "keyword" else _ranked_score(scored, 0.3, limit)


def two_stage_search(queries: DataFrame, chunks: DataFrame, backend: str, limit: int = 10, ties=("chunk_id",)) -> DataFrame:
    """Hybrid search as over a remote index, which is asked for more hits than wanted, as many as ``candidate_limit`` says; the mixture ranks those alone.

    A backend that is asked once, by vector, has the keyword score of each candidate; of one that is asked for both parts, a
    chunk that only one part gave has 0 for the other.
    """
    asked = candidate_limit(backend, "hybrid", limit)
    scored = with_scores(queries, chunks, backend).where("semantic is not null")
    both = top_k(scored, asked.get("semantic", asked.get("hybrid")), "semantic", ties=ties).select("query_id", *ties, "semantic", "keyword")
    if "keyword" in asked:
        worded = top_k(scored.where("keyword > 0"), asked["keyword"], "keyword", ties=ties).select("query_id", *ties, "keyword")
        both = both.drop("keyword").join(worded, ["query_id", *ties], "full_outer").fillna(0.0, ["semantic", "keyword"])
    mixed = both.withColumn("score", F.round(mixed_score(backend, F.col("semantic"), F.col("keyword")), 6))
    return top_k(mixed.where(F.col("score") >= threshold_of(backend, "hybrid", None)), limit, ties=ties)


def diverse_top_k(
    scored: DataFrame, k, score: str = "similarity", by: str = "query_id", source: str = "source", ties=("doc_id", "chunk_index")
) -> DataFrame:
    """The best chunk of each document first, then the best of the rest, ``k`` in all: ``rank``.

    A source is the document's name with a chunk label; the document is what stands before it.
    """
    document = source_document(source)
    order = [F.desc(score), *ties]
    in_document = W.partitionBy(by, "_document").orderBy(*order)
    overall = W.partitionBy(by).orderBy(F.desc("_first"), *order)
    ranked = scored.withColumn("_document", document).withColumn("_nth", F.row_number().over(in_document))
    return (
        ranked.withColumn("_first", F.col("_nth") == 1)
        .withColumn("rank", F.row_number().over(overall))
        .where(F.col("rank") <= k)
        .drop("_document", "_nth", "_first")
    )


def token_prefix(ranked: DataFrame, budget, by: str = "query_id", tokens: str = "tokens") -> DataFrame:
    """Chunks in rank order while their tokens fit; the first that doesn't ends the list."""
    running = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("tokens_so_far", F.sum(tokens).over(running)).where(F.col("tokens_so_far") <= budget)


def merge_hybrid(semantic: DataFrame, keyword: DataFrame, key: str = "chunk_id", profile: str = "chroma") -> DataFrame:
    """Semantic hits with their keyword score, and keyword-only hits that score above 0."""
    s = semantic.select(F.col(key).alias("_s"), F.col("score").alias("semantic_score"))
    k = keyword.select(F.col(key).alias("_k"), F.col("score").alias("keyword_score"))
    joined = s.join(k, F.col("_s") == F.col("_k"), "full_outer").where("_s is not null or keyword_score > 0")
    sem, kw = F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    return joined.select(
        F.coalesce("_s", "_k").alias(key), sem.alias("semantic_score"), kw.alias("keyword_score"), mixed_score(profile, sem, kw).alias("score")
    )

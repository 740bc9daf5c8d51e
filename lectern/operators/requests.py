"""Search requests: what is wrong with them, how they degrade, and how their results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import col, first_given, trim

MODES = ("semantic", "keyword", "hybrid")


def request_problem(question, mode, has_vector, documents) -> Column:
    """Why a request can't be answered, null if it can; only semantic search can't do without a vector."""
    return (
        F.when((col(mode) == "semantic") & ~col(has_vector), "no embedding for semantic search")
        .when(trim(F.coalesce(col(question), F.lit(""))) == "", "empty question")
        .when(col(documents) == 0, "no documents")
        .when(~F.coalesce(col(mode).isin(*MODES), F.lit(False)), "unknown mode")
    )


def effective_mode(mode, has_vector) -> Column:
    """Hybrid search without a vector is keyword search."""
    return F.when((col(mode) == "hybrid") & ~col(has_vector), "keyword").otherwise(col(mode))


def checked_requests(requests: DataFrame, documents: int, question="question", mode="mode", embedding="embedding") -> DataFrame:
    """``requests`` with ``problem``, ``effective`` mode and ``embedding_generated``."""
    generated = F.coalesce(F.size(embedding) > 0, F.lit(False)) & col(mode).isin("semantic", "hybrid")
    return requests.withColumns(
        {
            "problem": request_problem(question, mode, generated, F.lit(documents)),
            "effective": effective_mode(mode, generated),
            "embedding_generated": generated,
        }
    )


def with_defaults(results: DataFrame, mode: str, rank: str = "rank") -> DataFrame:
    """Results as shown: id, source, document id and chunk index have defaults where missing or empty."""
    shown = first_given(F.col("chunk_id").cast("string"), F.concat(F.lit("result-"), (F.col(rank) - 1).cast("string")))
    return results.withColumns(
        {
            "id": shown,
            "source": first_given("source", F.lit("Unknown Document")),
            "document": first_given(F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")),
            "chunk_index": F.coalesce("chunk_index", F.lit(0)),
            "search_mode": F.lit(mode),
        }
    )


def distance_score(distance) -> Column:
    """A similarity from a distance: what is missing to 1."""
    return F.lit(1.0) - col(distance).cast("double")


def candidate_limit(backend: str, mode: str, limit: int) -> dict[str, int]:
    """How many rows a remote index would be asked for, by part of the search. Factors and bounds by backend."""
    factors = {
        ("pinecone", "keyword"): {"keyword": (10, 1000)}, ("chroma", "keyword"): {"keyword": (20, 1000)},
        ("pinecone", "hybrid"): {"hybrid": (5, 1000)}, ("chroma", "hybrid"): {"semantic": (5, 100), "keyword": (10, 200)},
    }
    return {part: min(most, times * limit) for part, (times, most) in factors.get((backend, mode), {mode: (1, limit)}).items()}


def tab_badges(documents: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts that the tabs show: documents, and questions asked."""
    return documents.agg(F.count("*").alias("documents")).join(messages.agg(F.count_if(F.col("role") == "user").alias("chat")))

"""Ingest: documents to chunks, embeddings and index rows in one plan, with what can't be ingested set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.embedding import EMBEDDERS, with_vectors
from lectern.functions.text import col

from .chunking import chunk_adaptive, exploded

#: Vectors and which embedder made them.
EMBEDDED = ("embedding", "embedder")


def with_chunks(docs: DataFrame, text: str = "text", chunker: Callable[[str], Column] = chunk_adaptive) -> DataFrame:
    """``docs`` with ``chunks`` and ``problem``: why a document can't be ingested, null if it can."""
    cut = docs.withColumn("chunks", F.coalesce(chunker(text), F.array().cast("array<string>")))
    return cut.withColumn("problem", F.when(_blank(text), "no text").when(F.size("chunks") == 0, "no chunks"))


def _blank(text) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(r"\S")


def embed_chunks(docs: DataFrame, embedder: str = "hashed", chunks: str = "chunks", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each chunk: ``doc_id``, ``chunk_id``, ``chunk_index``, ``content``, its ``embedding``, which ``embedder`` made it, and the columns to ``keep``.

    A chunk is embedded where it stands, so no join and no count of vectors is needed.
    """
    rows = exploded(docs, chunks, doc_id, *keep)
    chunk_id = F.concat_ws("_", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string"))
    rows = rows.select(F.col(doc_id).alias("doc_id"), chunk_id.alias("chunk_id"), "chunk_index", "content", *keep)
    embedded = with_vectors(rows, "content", embedder, keep_text=True)
    return embedded.select("doc_id", "chunk_id", "chunk_index", "content", "embedding", F.lit(embedder).alias("embedder"), *keep)


def ingested(docs: DataFrame, embedder: str = "hashed", text: str = "text", chunker: Callable[[str], Column] = chunk_adaptive, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows of sound documents, each text cut once: one without chunks has no rows, so only blank texts are asked for."""
    return embed_chunks(with_chunks(docs.where(~_blank(text)), text, chunker), embedder, keep=keep)


def ingest(docs: DataFrame, embedder: str = "hashed", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chunk rows of sound documents, and the documents that have a ``problem``."""
    return ingested(docs, embedder, text), with_chunks(docs, text).where("problem is not null").drop("chunks")


def regenerate(chunks: DataFrame, embedder: str = "hashed", every: bool = False) -> DataFrame:
    """Chunk rows whose vectors are missing or made by another embedder (or all of them) embedded again."""
    stale = F.lit(True) if every else ~F.coalesce((F.size("embedding") > 0) & (F.col("embedder") == embedder), F.lit(False))
    anew = F.when(stale, EMBEDDERS[embedder]("content")).otherwise(F.col("embedding"))
    return chunks.withColumns({"embedding": anew, "embedder": F.lit(embedder), "regenerated": stale})


def checked_documents(docs: DataFrame, chunks: str = "chunks", embeddings: str = "embeddings") -> DataFrame:
    """``docs`` with ``problem``: no chunks, an empty vector; and ``regenerate``: as many vectors as chunks are needed."""
    c, e = F.coalesce(F.size(chunks), F.lit(0)), F.coalesce(F.size(embeddings), F.lit(0))
    empty = F.coalesce(F.exists(embeddings, lambda v: F.coalesce(F.size(v), F.lit(0)) <= 0), F.lit(False))
    problem = F.when(c <= 0, "no chunks").when((c == e) & empty, "empty embedding")
    return docs.withColumns({"problem": problem, "regenerate": (c > 0) & (c != e)})


def cascade_delete(doc_ids: list, *tables: DataFrame, doc_id: str = "doc_id") -> list[DataFrame]:
    """Each table (documents, chunks, vectors) without the rows of these documents."""
    from .index import delete_documents

    return [delete_documents(t, doc_ids, doc_id) for t in tables]

"""A training corpus from raw documents: five stages, each one operator of ``lectern.llm``.

A stage takes all rows its predecessor kept and returns the columns of documents; the last returns
the pieces that the packed windows are made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, line_dedup, minhash, mixing, packing
from lectern.llm.common import fresh, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no text, or not a letter in it) go."""
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = language.predict(docs, language.train(docs), docs.columns, names=names)
    return found.where(F.col(names[0]) != "und").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; documents stay. Exact copies count as one page, so a group of them stays for the next stage."""
    return with_length(line_dedup.drop_boilerplate(docs, distinct=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (of several the first read, null ids last).

    Rows are told apart by a number of their own, so rows that repeat an id, or have none, are judged by their texts.
    """
    row, group, first = (fresh(docs, x) for x in ("_row", "_group", "_first"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), **NEAR)
    moved = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias(row), F.col("component_id").alias(group)), "copies")
    grouped = moved.unionByName(moved.select(F.col(group).alias(row), group).distinct())
    named = materialize(grouped.join(numbered.select(row, F.col("doc_id").alias("id")), row), "grouped")
    order = F.struct(F.col("id").isNull(), "id", row)
    stays = materialize(named.groupBy(group).agg(F.min(order)[row].alias(first)), "stay")
    gone = named.join(stays, group).where(F.col(row) != F.col(first)).select(row)
    return numbered.join(gone, row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, filled with documents that share rare words."""
    return packing.pack(docs, packing.default_tokenizer())


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


#: Near copies share 80 % of their five-word shingles. With these bounds a pair at 0.8 is missed below 1e-4.
NEAR = {"shingle": 5, "percent": 80, "radius": 26, "chunks": 14}

STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near copies", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: Training, signatures and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

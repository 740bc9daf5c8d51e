"""How the test tables stand for documents, chunks, queries and interactions, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of texts, of which each row is much work.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out so that each core has a part; a table of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark, name: str) -> str:
    """A folder of its own in the cluster's shared one; a session in one process can do without that and uses its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lectern-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_folders(spark: SparkSession) -> None:
    """Delete what the queries of this application have written; results that are still to be computed need it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "x")).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose author is the source and whose only tag is the language."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("author"), F.array("lang").alias("tags"), "text", "lang", "source", "n_chars")


def chunks_apart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as chunks, and their texts: the label is the document, the vector id the chunk; the text is the document of that id."""
    e = table(spark, sf_dir, "embeddings")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    # texts outside the vectors' ids can't meet one: they stay where they are read, and are neither dealt out nor shuffled
    ends = e.agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).first()
    held = e.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("int").alias("chunk_index"),
        F.concat(F.lit("doc"), F.col("label").cast("string")).alias("source"), "embedding",
    )
    return held, spread(d.where(F.col("chunk_id").between(ends["first"], ends["last"])))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have a text, with it."""
    held, texts = chunks_apart(spark, sf_dir)
    return held.join(texts, "chunk_id").select("chunk_id", "doc_id", "chunk_index", "source", "content", "embedding")


def vector_queries(spark: SparkSession, sf_dir: str, questions: dict[int, str]) -> DataFrame:
    """One query for each vector id given, with its question."""
    asked = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    e = table(spark, sf_dir, "embeddings")
    return asked.join(e, F.col("vec_id") == F.col("query_id")).select("query_id", "question", "embedding")


# -- SQL for the same ------------------------------------------------------------------------------

CHUNKS_SQL = """
SELECT e.vec_id AS chunk_id, e.label::VARCHAR AS doc_id, e.vec_id::INTEGER AS chunk_index, 'doc' || e.label AS source,
       d.text AS content, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"""


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def keyword_sql(query: str, content: str) -> str:
    """The keyword score of two columns, as one SQL expression."""
    q, c = norm_sql(query), norm_sql(content)
    asked, there = f"list_filter(string_split({q}, ' '), lambda w: w <> '')", f"string_split({c}, ' ')"
    exact = f"len(list_filter({asked}, lambda w: list_contains({there}, w)))"
    partly = (
        f"len(list_filter({asked}, lambda w: NOT list_contains({there}, w) AND "
        f"len(list_filter({there}, lambda t: contains(t, w) OR contains(w, t))) > 0))"
    )
    n = f"len({asked})"
    base = f"({exact} / {n} + 0.5 * {partly} / {n})"
    base = f"CASE WHEN {n} = 1 AND {exact} > 0 THEN least(1.0, 2 * {base}) ELSE {base} END"
    times = f"((length({c}) - length(replace({c}, {q}, ''))) / length({q}))"
    bonus = f"CASE WHEN {exact} > 0 THEN least(0.3, 0.1 * {times}) ELSE 0.0 END"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE least(1.0, {base} + {bonus})::DOUBLE END"

"""Keyword search that reads the texts of candidates only: postings by word, and words by their grams.

A chunk has a score above 0 if one of its words equals a word of the question, contains it, or is contained in it. Words equal to or contained in a
question's word are found among its substrings; words that contain it by one of its grams of up to three letters, in a table of the
vocabulary. Postings of these words give the candidates, and the exact score is computed for them alone.
Both tables are partitioned by a hash of their key, so a search reads the partitions of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import col, keyword_form, keyword_score_of

from .search import PROFILES, few, threshold_of, top_k

GRAM = 3
BUCKETS = 64


def _bucket(key, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _pieces(word, most: int | None = None) -> Column:
    """Substrings of a word, of at most ``most`` letters if given."""
    w = col(word)
    n = F.length(w)
    sizes = F.sequence(F.lit(1), n if most is None else F.least(n, F.lit(most)))
    of_size = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(w, i, k))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(sizes, of_size)))).otherwise(F.array().cast("array<string>"))


class KeywordIndex:
    """The index in a folder that all executors share; built once for a table of chunks."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, chunks: DataFrame) -> None:
        """Postings of ``chunks`` (``chunk_id``, ``content``)."""
        # not ``explode``: Spark puts filters on the array before that, for which each text is cut again
        words = F.array_distinct(keyword_form("content", True)["words"])
        posts = chunks.select(F.explode_outer(words).alias("word"), "chunk_id").where("word is not null").withColumn("bucket", _bucket("word", self.buckets))
        posts.repartition("bucket", _bucket("chunk_id", 4)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        vocabulary = self._posts().groupBy("word").agg(F.count("*").alias("n"))
        grams = vocabulary.select("word", F.explode(_pieces("word", GRAM)).alias("gram")).withColumn("bucket", _bucket("gram", self.buckets))
        grams.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/grams")

    def _posts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _in_buckets(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows of the partitions in which ``keys`` (their buckets, ``self.buckets`` at most) lie."""
        found = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        return table.where(F.col("bucket").isin(found) if found else F.lit(False))

    def matches(self, queries: DataFrame) -> DataFrame:
        """``query_id``, ``word``: words of the vocabulary that equal, contain or lie within a word of the question."""
        asked = queries.select("query_id", F.explode(F.array_distinct(F.coalesce(keyword_form("question", True)["words"], F.array()))).alias("asked"))
        within = asked.select("query_id", F.explode(_pieces("asked")).alias("word")).distinct()
        # the last gram: endings tell words apart no worse than beginnings
        gram = F.when(F.length("asked") <= GRAM, F.col("asked")).otherwise(F.substring("asked", -GRAM, GRAM))
        keyed = asked.withColumn("gram", gram).withColumn("bucket", _bucket("gram", self.buckets))
        grams = self._in_buckets(self.spark.read.parquet(f"{self.path}/grams"), keyed).drop("bucket")
        around = grams.join(few(keyed.drop("bucket"), 10_000), "gram").where(F.contains("word", F.col("asked"))).select("query_id", "word")
        return within.unionByName(around).distinct()

    def candidates(self, queries: DataFrame) -> DataFrame:
        """``query_id``, ``chunk_id`` of all chunks whose score is above 0."""
        words = self.matches(queries).withColumn("bucket", _bucket("word", self.buckets))
        posts = self._in_buckets(self._posts(), words)
        return posts.join(few(words.drop("bucket"), 100_000), "word").select("query_id", "chunk_id").distinct()

    def search(self, queries: DataFrame, chunks: DataFrame, limit: int = 10, profile: str = "local", threshold: float | None = None, ties=("chunk_id",)) -> DataFrame:
        """The best chunks of each question with a score above 0 and at least the threshold; texts of candidates only are scored."""
        # a text meets its questions as one row: its form is made once for all of them, and each score once
        forms = queries.select("query_id", keyword_form("question", True).alias("form"))
        asking = self.candidates(queries).join(few(forms), "query_id").groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "form")).alias("_asking"))
        held = chunks.join(asking, "chunk_id").withColumn("_form", keyword_form("content"))
        score = lambda q: keyword_score_of(q["form"], "_form", PROFILES[profile].empty_is_zero)
        hits = F.transform("_asking", lambda q: F.struct(q["query_id"].alias("query_id"), score(q).alias("score")))
        scored = held.select(*chunks.columns, F.explode_outer(hits).alias("_hit")).select(*chunks.columns, "_hit.*")
        least = threshold_of(profile, "keyword", threshold) or 0.0
        return top_k(scored.where((F.col("score") > 0) & (F.col("score") >= least)), limit, ties=ties)

"""A chunk index as a Parquet table: create, upsert, append, delete, clear, scan.

The table is partitioned by a hash of the chunk id. New rows are appended; upserts and deletes are joins that
rewrite only the partitions they touch.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import compile_filter

SCHEMA = (
    "chunk_id string, doc_id string, chunk_index int, source string, content string, embedding array<double>, "
    "author string, tags array<string>, date timestamp, ts timestamp"
)
#: Partitions of an index.
BUCKETS = 16


def latest(rows: DataFrame, key: str = "chunk_id", order: str = "ts") -> DataFrame:
    """One row for each key, the last written."""
    # rows written at one time: the greatest by what else they hold, so that reruns agree
    rest = F.xxhash64(*[c for c in rows.columns if c not in (key, order)]) if len(rows.columns) > 2 else F.lit(0)
    newest = W.partitionBy(key).orderBy(F.desc_nulls_last(order), rest)
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "ts") -> DataFrame:
    """``old`` with the rows of ``new`` put in: rows with an equal key are replaced."""
    new = latest(new, key, order)
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(rows: DataFrame, doc_ids: list, doc_id: str = "doc_id") -> DataFrame:
    """Rows of other documents; rows without a document id stay."""
    return rows.where(~F.coalesce(F.col(doc_id).isin(list(doc_ids)), F.lit(False)))


def merge_partial(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of ``changes`` put over theirs, by key."""
    named = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    merged = rows.join(named, F.col(key) == F.col("_key"), "left")
    return merged.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def validate(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """``rows`` with ``problem``: why a chunk can't be indexed, null if it can."""
    inf = F.lit(float("inf"))
    # the first is null if a number is, and the greatest is NaN if one is: no number is looked at by an expression of its own
    finite = F.coalesce(~F.array_contains("embedding", inf), F.lit(False)) & (F.array_max("embedding") < inf) & (F.array_min("embedding") > -inf)
    problem = (
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty content")
        .when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "empty embedding")
        .when(~finite, "embedding is not finite")
    )
    if dimension:
        problem = problem.when(F.size("embedding") != dimension, "wrong dimension")
    return rows.withColumn("problem", problem)


class ChunkIndex:
    """The index in a folder that all executors share.

    An index keeps its number of ``buckets``; choose it so that rewriting one is cheap. A change is computed in full before
    it replaces anything, and can be repeated if the driver stops midway. One writer at a time; scan again after a change.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, buckets: int = BUCKETS, metric: str = "cosine", content_chars: int | None = None):
        """An index that exists keeps its own dimension, buckets and metric. ``content_chars`` cuts the texts it stores, for
        the sake of a reader that takes no more; texts are whole without it."""
        self.spark, self.path, self.content_chars = spark, path.rstrip("/"), content_chars
        self.dimension, self.buckets, self.metric = dimension, buckets, metric
        if kept := self._kept():
            if dimension and kept["dimension"] and dimension != kept["dimension"]:
                raise ValueError(f"the index has vectors of {kept['dimension']} numbers, not {dimension}")
            self.dimension, self.buckets, self.metric = kept["dimension"] or dimension, kept["buckets"], kept["metric"]

    def _kept(self) -> dict | None:
        files, at = self._file(f"{self.path}/_index.json")
        if not files.exists(at):
            return None
        data = files.open(at)
        try:
            return json.loads(bytes(data.readAllBytes()))
        finally:
            data.close()

    def _keep(self) -> None:
        files, at = self._file(f"{self.path}/_index.json")
        out = files.create(at, True)
        out.write(bytearray(json.dumps({"dimension": self.dimension, "buckets": self.buckets, "metric": self.metric}).encode()))
        out.close()

    def _file(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self) -> bool:
        files, at = self._file(self.path)
        return files.exists(at)

    def create(self) -> None:
        """Make the index if it isn't there; what a writer left that stopped midway goes."""
        files, at = self._file(self.path)
        if files.exists(at.getParent()):
            for left in files.listStatus(at.getParent()):
                if re.fullmatch(rf"{re.escape(at.getName())}-(staged|new)-[0-9a-f]{{32}}", left.getPath().getName()):
                    files.delete(left.getPath(), True)
        for left in files.globStatus(self._file(f"{self.path}/.spark-staging-*")[1]) or []:
            files.delete(left.getPath(), True)
        if not self.exists():
            self.clear()

    def _rows(self) -> DataFrame:
        schema = f"{SCHEMA}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], schema)

    def scan(self, spec: dict | None = None) -> DataFrame:
        """Rows, or those that a filter dictionary lets through.

        Chunk ids asked for by ``$in`` or by value say in which partitions they can be, so only those are read; other
        comparisons reach the files' own statistics, as rows lie in order of their document.
        """
        rows = self._rows()
        asked = (spec or {}).get("chunk_id")
        ids = asked.get("$in", [asked["$eq"]] if "$eq" in asked else None) if isinstance(asked, dict) else [asked] if asked is not None else None
        if ids is not None:
            rows = rows.where(F.col("bucket").isin(self._buckets_of(ids)) if ids else F.lit(False))
        return rows.where(compile_filter(spec)).drop("bucket") if spec else rows.drop("bucket")

    def _bucket(self, chunk_id) -> Column:
        return F.pmod(F.xxhash64(chunk_id), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, ids: list) -> list[int]:
        wanted = self.spark.createDataFrame([(str(i),) for i in ids], "id string")
        return sorted({r["b"] for r in wanted.select(self._bucket("id").alias("b")).collect()})

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``chunk_id`` and more) as the index keeps them: dealt by ``bucket`` and in order. Columns that are made of
        these rows' own afterwards, such as long texts, are then made where they are written, by ``append(dealt=True)``."""
        order = [c for c in ("bucket", "doc_id", "chunk_index") if c == "bucket" or c in rows.columns]
        return rows.withColumn("bucket", self._bucket(F.col("chunk_id").cast("string"))).hint("rebalance", "bucket").sortWithinPartitions(*order)

    def _shaped(self, rows: DataFrame, dealt: bool = False) -> DataFrame:
        known = {f.split(" ")[0]: f.split(" ", 1)[1] for f in SCHEMA.split(", ")}
        cols = [(F.col(c) if c in rows.columns else F.current_timestamp() if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
        shaped = rows.select(*cols, *(["bucket"] if dealt else []))
        if self.content_chars:
            shaped = shaped.withColumn("content", F.substring("content", 1, self.content_chars))
        return shaped if dealt else shaped.withColumn("bucket", self._bucket("chunk_id"))

    def _write(self, rows: DataFrame, mode: str, partitions: str = "static") -> None:
        # large partitions are written by several tasks, small ones together by one, as their sizes turn out
        self._put(rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id", "chunk_index"), mode, partitions)

    def _put(self, ordered: DataFrame, mode: str, partitions: str = "static") -> None:
        # texts of chunks overlap, and long ones repeat themselves farther apart than the usual codec sees
        ordered.write.mode(mode).option("partitionOverwriteMode", partitions).option("compression", "zstd").partitionBy("bucket").parquet(self.path)

    def _parts(self, bucket: int) -> set[str]:
        files, at = self._file(f"{self.path}/bucket={bucket}")
        return {f.getPath().getName() for f in files.listStatus(at)} if files.exists(at) else set()

    def _replace(self, buckets: list[int], kept: Callable[[DataFrame], DataFrame], new: DataFrame | None = None, dealt: bool = False) -> None:
        """These buckets with what is ``kept`` of their rows and with ``new`` ones, in one write that replaces them when it is whole; an emptied one goes."""
        rows = kept(self._rows().where(F.col("bucket").isin(buckets)))
        rows = rows if new is None else rows.unionByName(new)
        before = {b: self._parts(b) for b in buckets}
        if dealt:
            self._put(rows.sortWithinPartitions("bucket", "doc_id", "chunk_index"), "overwrite", "dynamic")
        else:
            self._write(rows, "overwrite", "dynamic")
        for b, parts in before.items():
            if parts & self._parts(b):  # no row was written to it
                files, at = self._file(f"{self.path}/bucket={b}")
                files.delete(at, True)

    def upsert(self, rows: DataFrame) -> None:
        sound = validate(self._shaped(rows), self.dimension).where("problem is null").drop("problem")
        staged = f"{self.path}-new-{uuid.uuid4().hex}"
        latest(sound).write.parquet(staged)
        new = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(staged)
        self._replace(sorted(_numbers(new)), lambda old: old.join(new.select("chunk_id"), "chunk_id", "left_anti"), new)
        files, at = self._file(staged)
        files.delete(at, True)

    def replace_documents(self, rows: DataFrame, documents: DataFrame | None = None, stored: bool = False, dealt: bool = False) -> None:
        """The documents of ``rows`` as they are there: their older chunks go, also those beyond the new ones' number.

        ``documents`` names them (``doc_id``) if some of them have no rows now; chunks of these go too. Rows that are ``stored``, each
        chunk once, are read where they lie; others are written apart first, as they are needed more than once. Rows that were ``dealt`` to
        many tasks are written by these, not dealt again.
        """
        shaped = self._shaped(rows)
        new, staged = validate(shaped, self.dimension).where("problem is null").drop("problem"), f"{self.path}-new-{uuid.uuid4().hex}"
        if not stored:
            latest(new).write.parquet(staged)
            shaped = new = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(staged)
        anew = (new.select("doc_id") if documents is None else shaped.select("doc_id").unionByName(documents.select(F.col("doc_id").cast("string")))).distinct()
        touched = _numbers(shaped) | _numbers(self._rows().join(anew, "doc_id", "left_semi"))
        self._replace(sorted(touched), lambda old: old.join(anew, "doc_id", "left_anti"), new, dealt)
        files, at = self._file(staged)
        files.delete(at, True)

    def append(self, rows: DataFrame, dealt: bool = False) -> None:
        """Without looking for equal keys. Rows that were ``dealt`` are written as they lie."""
        shaped = self._shaped(rows, dealt)
        self._put(shaped, "append") if dealt else self._write(shaped, "append")

    def delete(self, doc_ids: list) -> None:
        ids = [str(d) for d in doc_ids]
        self._replace(sorted(_numbers(self._rows().where(F.col("doc_id").isin(ids)))), lambda old: delete_documents(old, ids))

    def clear(self) -> None:
        self._write(self._shaped(self.spark.createDataFrame([], SCHEMA)), "overwrite")
        self._keep()

    def count(self) -> int:
        return self.scan().count()

    def test_connection(self) -> bool:
        return self.exists()

    def check(self) -> DataFrame:
        """One row: whether the index is there, its rows and documents, and how many rows have a vector of its dimension."""
        size = F.coalesce(F.size("embedding"), F.lit(0))
        fits = size == self.dimension if self.dimension else size > 0
        return self.scan().agg(F.lit(self.exists()).alias("exists"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_if(fits).alias("fitting"))


def _numbers(rows: DataFrame) -> set[int]:
    """Buckets that have rows: as many numbers as an index has partitions at most."""
    return {r["bucket"] for r in rows.select("bucket").distinct().collect()}

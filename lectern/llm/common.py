"""What several of these operators share: cut lineage, connected components, streamed groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out so that each core has a part; a table of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would read it by, so that others who open it mean the same store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a session in one process can do without and gets one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file:///tmp/lectern-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
    return qualified(spark, path).rstrip("/")


#: Folders of the scopes that ``intermediate`` has opened, innermost last.
_scopes: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """Where this application writes tables of its own, within the innermost scope."""
    return "/".join([shared_dir(spark), "lectern", spark.sparkContext.applicationId, *_scopes])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and the
    files outlive any executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate(spark: SparkSession):
    """Tables that operators write within this block go at its end; write their results before that."""
    _scopes.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        path = work_dir(spark)
        _scopes.pop()
        _delete(spark, path)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete this application's tables; results that are still to be computed need theirs. Those of other applications stay."""
    _delete(spark, "/".join([shared_dir(spark), "lectern", spark.sparkContext.applicationId]))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with a number if ``df`` has such a column."""
    taken, found, n = {c.lower() for c in df.columns}, name, 0
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def words_of(text) -> F.Column:
    """Number of words of a text column; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as long columns ``a`` and ``b``.

    Returns ``node``, ``root`` (the component's smallest node) for every node but the roots. Large-star
    and small-star rounds alternate until the edges are stars. Minima by node are tables of their own: joins with them are
    broadcasts where their files are small, else shuffles of which Spark splits hot nodes.
    An edge to a node without a smaller neighbour stays as it is.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while True:
        low = _least(now)
        if not low.take(1) or _are_stars(now, low):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        of = low.select(F.col("a").alias("of"), "m")
        large = now.join(of, now["b"] == of["of"], "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(large.distinct(), "large-star")
        least = _least(large).select(F.col("a").alias("of"), "m")
        moved = large.join(least, large["a"] == least["of"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(kept).distinct(), "small-star")


def _least(edges: DataFrame) -> DataFrame:
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def _are_stars(edges: DataFrame, low: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, and that has none."""
    return not low.where("n > 1").take(1) and not edges.join(low.select(F.col("a").alias("of")), F.col("b") == F.col("of"), "left_semi").take(1)


def by_group(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of adjacent rows with equal keys, from batches sorted by ``keys``, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            if not pa.types.is_integer(column.type) or column.null_count:
                column = pc.fill_null(column.dictionary_encode(null_encoding="encode").indices, -1)
            changes |= np.diff(column.to_numpy(zero_copy_only=False)) != 0
        starts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        firsts = batch.take(pa.array(starts[:-1])).select(keys)
        for start, end, key in zip(starts, starts[1:], zip(*(c.to_pylist() for c in firsts.columns))):
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield held_key, pa.Table.from_batches(held)


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, and to about ``size`` bytes of a text column where rows are shorter than that."""
    for big in batches:
        lengths = pc.fill_null(pc.binary_length(big.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (i - start == rows or held + n > size):
                yield big.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < big.num_rows:
            yield big.slice(start)


def arrow_map(df: DataFrame, fn: Callable, schema: str, **parameters) -> DataFrame:
    """``mapInArrow`` of a generator ``fn(batches, **parameters)``."""
    return df.mapInArrow(lambda batches: fn(batches, **parameters), schema)

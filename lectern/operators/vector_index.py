"""Exact nearest chunks without scoring every chunk: cells with a pivot and a radius, pruned by what they can hold at best.

Unit vectors are dealt to the nearest of some pivots, fitted on a bounded sample; a cell knows the largest angle of its vectors to its pivot. No
vector of a cell is nearer to a query than the angle to the pivot less that radius, so a cell whose bound is below the query's k-th score, or below the
threshold, is left out. Rows lie in one Parquet table partitioned by cell, so a cell that no query needs is not read. Vectors
without a direction, or of another length than most, have a cell of their own that is always read.

How much is left out depends on the vectors: clustered ones need few cells, vectors without structure nearly all.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.similarity import cosine_of, dot, norm

from .search import few, top_k

SAMPLE, CELLS, ROUNDS = 4_096, (1, 1_024), 8
#: The cell of vectors that have no place among the others.
APART = -1
_SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_pivots(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Directions in the midst of the rows of ``x``, which are unit vectors."""
    pivots = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ pivots.T).argmax(axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        pivots = np.where(size > 1e-9, total / np.maximum(size, 1e-9), pivots)
    return pivots


def _rows(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column have ``size`` finite components and a direction, and those as unit vectors."""
    lists = column.to_pylist()
    sound = np.array([v is not None and len(v) == size and None not in v for v in lists], bool)
    x = np.array([v for v, ok in zip(lists, sound) if ok], np.float64).reshape(int(sound.sum()), size)
    usable = np.isfinite(x).all(axis=1) & (np.abs(x) > 0).any(axis=1)
    sound[np.flatnonzero(sound)[~usable]] = False
    return sound, _unit(x[usable]) if usable.any() else x[usable]


class VectorIndex:
    """An index in a folder that all executors share; built once for a table of chunks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Cells that the last search read.
        self.cells_read: list[int] = []

    def build(self, chunks: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 5) -> None:
        """Rows of ``chunks`` (``embedding`` and more) by cell; chunks without a vector are left out."""
        rows = chunks.where(F.col("embedding").isNotNull())
        sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
        drawn = rows.where(F.size("embedding") == size).where(F.rand(seed) < min(1.0, 1.5 * sample / max(n, 1))).select("embedding").limit(sample)
        table = drawn.toArrow()
        _, x = _rows(table.column("embedding"), size)
        cells = cells or int(np.clip(round(math.sqrt(n)), *CELLS))
        pivots = fit_pivots(x, cells, seed=seed) if len(x) else np.zeros((0, size))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

        def place(batches):
            for batch in batches:
                sound, unit = _rows(batch.column("embedding"), size)
                cell, angle = np.full(batch.num_rows, APART, np.int32), np.zeros(batch.num_rows)
                if len(unit) and len(pivots):
                    near = unit @ pivots.T
                    cell[sound] = near.argmax(axis=1)
                    angle[sound] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(cell)], names=[*batch.schema.names, "_angle", "cell"])

        placed = rows.mapInArrow(place, f"{kinds}, _angle double, cell int")
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        kept = self.spark.read.schema(f"{kinds}, _angle double, cell int").parquet(f"{self.path}/rows")
        found = kept.groupBy("cell").agg(F.max("_angle").alias("radius"), F.count("*").alias("n"))
        pivot = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "of int, pivot array<double>")
        found.join(F.broadcast(pivot), F.col("cell") == F.col("of"), "left").drop("of").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        self.__dict__.pop("_cells", None)

    @cached_property
    def _cells(self) -> list:
        """One row for each cell, ``CELLS`` at most."""
        return sorted(self.spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r["cell"])

    def _plan(self, queries: DataFrame, k: int) -> DataFrame:
        """For each query the cells that can matter: ``cell``, ``bound``, and ``first`` for those that hold ``k`` vectors near it."""
        cells = self._cells
        pivots = np.array([c["pivot"] for c in cells if c["pivot"] is not None], np.float64)
        numbers, radius, n = (np.array([c[x] for c in cells if c["pivot"] is not None]) for x in ("cell", "radius", "n"))
        apart = any(c["cell"] == APART for c in cells)

        def bounds(batches):
            for batch in batches:
                ids, out = batch.column("query_id").to_pylist(), []
                size = pivots.shape[1] if len(pivots) else 0
                sound, unit = _rows(batch.column("embedding"), size)
                near = np.arccos(np.clip(unit @ pivots.T, -1, 1)) if len(unit) else None
                for q, place in zip(ids, np.where(sound, np.cumsum(sound) - 1, -1)):
                    if place >= 0:
                        best = np.cos(np.maximum(0.0, near[place] - radius)) + _SLACK
                        order = np.argsort(near[place], kind="stable")
                        before = np.cumsum(n[order]) - n[order]
                        out += [(q, int(numbers[c]), float(best[c]), bool(b < k)) for c, b in zip(order, before)]
                    else:  # a query without a direction is as near to all
                        out += [(q, int(c), 1.0, True) for c in numbers]
                    if apart:
                        out.append((q, APART, 1.0, True))
                if out:
                    columns = list(zip(*out))
                    types = [batch.schema.field("query_id").type, pa.int32(), pa.float64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "cell", "bound", "first"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "embedding").mapInArrow(bounds, f"query_id {kind}, cell int, bound double, first boolean")

    def _scored(self, queries: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows of the planned cells with their cosine to the query; only those cells are read."""
        wanted = sorted(r["cell"] for r in plan.select("cell").distinct().collect())  # of ``CELLS`` at most
        self.cells_read = sorted({*self.cells_read, *wanted})
        asked = queries.select("query_id", F.col("embedding").alias("q_vector"), norm("embedding").alias("q_norm"))
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(wanted) if wanted else F.lit(False)).drop("_angle")
        pairs = rows.join(few(plan.join(asked, "query_id"), 20_000), "cell")
        same = F.size("q_vector") == F.size("embedding")
        score = F.when(same, cosine_of(dot("q_vector", "embedding"), F.col("q_norm"), norm("embedding"))).otherwise(0.0)
        return pairs.withColumn("score", score).where(~F.isnan("score")).drop("q_vector", "q_norm", "cell", "bound", "first")

    def search(self, queries: DataFrame, k: int = 10, threshold: float = 0.0, ties=("chunk_id",)) -> DataFrame:
        """The ``k`` chunks nearest to each query (``query_id``, ``embedding``) that reach the threshold: ``rank``, ``score``, chunk columns.

        An index without rows has no chunk columns to give.
        """
        self.cells_read = []
        queries = queries.where(F.col("embedding").isNotNull())
        if not self._cells:
            return queries.where("false").select("query_id", F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
        plan = self._plan(queries, k).where(F.col("bound") >= threshold)
        near = top_k(self._scored(queries, plan.where("first")).where(F.col("score") >= threshold), k, ties=ties)
        kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        open_plan = plan.where("not first").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        more = self._scored(queries, open_plan).where(F.col("score") >= threshold)
        return top_k(near.drop("rank").unionByName(more), k, ties=ties)

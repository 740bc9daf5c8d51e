"""Approximate nearest neighbours by an inverted multi-index, for largest inner products.

Vectors are cut in two halves and each half is quantised by its own centroids; a pair of centroids is a
cell. The centroids come from a bounded sample; every vector is indexed. A query ranks centroids of
each half by inner product and a heap walks centroid pairs in order of summed distance (the negative
summed product) until the cells taken hold a share of all vectors, and ``k`` besides those with the query's id. These are reranked by exact
inner products in double precision.

Cells are dealt to units of at most ``UNIT`` vectors; a cell above that is split by hash over units of
its own. A unit's task holds its vectors and streams the queries that probe it, a product of two matrices for each batch; a
partition keeps the best ``k`` of each query over its units, and the best of these are the result. Only the number of vectors in
each cell is gathered on the driver, ``CENTROIDS ** 2`` numbers at most.

The share is fitted to the recall asked for: for some vectors of the sample, the nearest others in it are known exactly, and so is how far
the walk has to go for each. On vectors without structure, as in the test tables, 0.9 needs more than half of all
cells; clustered vectors need far less.

Defined results: vectors that are null, zero, hold null or non-finite components, or have no
``vec_id`` take no part, nor do vectors of another length than the most frequent one (ties: the
longer); a query is never its own neighbour, whatever rows repeat its id; rows that repeat an id are
candidates of their own and a repeated query has one result, for the smallest of its vectors by bytes; fewer than ``k`` other vectors
give shorter lists; ties go to the smaller ``vec_id``; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table
from .embedding_dedup import usable

K = 20
EVERY = 20
#: Centroids of each half: as many as leave about ``UNIT`` vectors a cell, within these bounds.
CENTROIDS = 32, 256
#: Share of the nearest vectors of sampled queries that the walk has to reach, and how many such queries.
RECALL, TRIED = 0.95, 128
SAMPLE = 16_384
UNIT = 1_024
SEED = 515


def fit_centroids(x: np.ndarray, k: int, rounds: int = 15, seed: int = SEED) -> np.ndarray:
    """Centroids of rows of ``x`` by Lloyd's rounds; ``k`` at most as many as distinct rows."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by rising summed distance until they hold ``wanted`` vectors; ``counts`` by cell."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d1, d2 = first[a].tolist(), second[b].tolist()
    heap, seen, cells, held = [(d1[0] + d2[0], 0, 0)], {(0, 0)}, [], 0
    a, b, counts = a.tolist(), b.tolist(), counts.tolist()
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if n := counts[a[i]][b[j]]:
            cells.append((a[i], b[j]))
            held += n
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(d1) and j < len(d2) and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(heap, (d1[i] + d2[j], i, j))
    return cells


def fitted_share(halves, x: np.ndarray, counts: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> float:
    """The share of all vectors to probe so that ``recall`` of the nearest vectors are reached, for queries among the sample ``x``.

    The sample is sparser than the table, so fewer neighbours of it count: as many as the table has of the ``k`` nearest in the sample's share.
    """
    (c1, c2), total, split = halves, counts.sum(), x.shape[1] // 2
    k = max(1, min(round(k * len(x) / total), len(x) - 1))
    one, two = nearest(x[:, :split], c1), nearest(x[:, split:], c2)
    before = np.zeros(counts.shape)
    needed = []
    for q in np.unique(np.linspace(0, len(x) - 1, tried).astype(int)):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argpartition(-score, k - 1)[:k]
        cells = walk(-(c1 @ x[q, :split]), -(c2 @ x[q, split:]), counts, total)
        sizes = np.array([counts[c] for c in cells])
        before[tuple(np.array(cells).T)] = np.cumsum(sizes) - sizes
        needed.append(before[one[best], two[best]] / total)
    return float(min(1.0, np.quantile(np.concatenate(needed), recall) + 1 / total))


def deal_units(counts: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first unit and how many units it is split over."""
    first, pieces = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    now, held = 0, 0
    for cell in zip(*np.nonzero(counts)):
        n = int(counts[cell])
        if held and held + n > unit:
            now, held = now + 1, 0
        first[cell] = now
        if n > unit:
            pieces[cell] = -(-n // unit)
            now, held = now + int(pieces[cell]), 0
        else:
            held += n
    return first, pieces


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _assign(batches, halves):
    c1, c2 = halves.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vector"))
        split = x.shape[1] // 2
        cells = [nearest(x[:, :split], c1), nearest(x[:, split:], c2)]
        raw = pa.array([v.tobytes() for v in x], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), raw, *(pa.array(c.astype(np.int32)) for c in cells)], names=["vec_id", "vector", "c1", "c2"]
        )


ROW = "unit long, kind int, vec_id long, vector binary, cells array<int>"


def _deal(batches, index, probed: float, k: int):
    """Each vector in its unit (kind 0, its cell); each query, a row with ``copies``, in every unit it probes (kind 1, the cells)."""
    (c1, c2), counts, first, pieces = index.value
    share, wide = probed * counts.sum(), counts.shape[1]

    def rows(batch):
        for vec_id, raw, i, j, copies in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vector", "c1", "c2", "copies"))):
            if not copies:
                unit = int(first[i, j]) + (vec_id * 0x9E3779B1 % 2**32) * int(pieces[i, j]) // 2**32
                yield unit, 0, vec_id, raw, [i * wide + j]
            else:
                v = np.frombuffer(raw)
                split = len(v) // 2
                probes: dict[int, list[int]] = {}
                for i, j in walk(-(c1 @ v[:split]), -(c2 @ v[split:]), counts, max(share, k + copies)):
                    for u in range(int(first[i, j]), int(first[i, j] + pieces[i, j])):
                        probes.setdefault(u, []).append(i * wide + j)
                for u, cells in probes.items():
                    yield u, 1, vec_id, raw, cells

    for big in batches:
        for at in range(0, big.num_rows, 64):
            columns = list(zip(*rows(big.slice(at, 64))))
            if columns:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["unit", "kind", "vec_id", "vector", "cells"]
                )


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order whatever the rows beside them, so equal vectors tie."""
    return (q * x).sum(axis=1)


def _best(rows: list[tuple], k: int) -> tuple:
    """The best ``k`` of each query among rows of query, vector and score."""
    query, vector, score = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vector[keep], score[keep]


def _rerank(batches, k: int, cells_total: int, held_rows: int = 400_000):
    """The best ``k`` of each query among all units of this partition; at most ``held_rows`` rows are held
    for that, what is above goes out early."""
    held, n = [], 0
    for rows in _unit_hits(batches, k, cells_total):
        held.append(rows)
        n += len(rows[0])
        if n > held_rows:
            held = [_best(held, k)]
            n = len(held[0][0])
            if n > held_rows // 2:
                yield _hit_batch(held.pop())
                n = 0
    if held:
        yield _hit_batch(_best(held, k))


def _hit_batch(rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["query_id", "vec_id", "score"])


def _unit_hits(batches, k: int, cells_total: int):
    unit, ids, vectors, cells = None, [], [], []
    x = None
    for batch in batches:
        columns = [batch.column(c) for c in ("unit", "kind", "vec_id", "vector", "cells")]
        units, kinds = columns[0].to_numpy(), columns[1].to_numpy()
        cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end <= start:
                continue
            part = [c.slice(start, end - start) for c in columns]
            got = np.frombuffer(b"".join(part[3].to_pylist())).reshape(end - start, -1)
            if units[start] != unit:
                unit, ids, vectors, cells, x = units[start], [], [], [], None
            if kinds[start] == 0:
                ids.append(part[2].to_numpy())
                vectors.append(got)
                cells += [c[0] for c in part[4].to_pylist()]
                continue
            if x is None:
                if not vectors:
                    continue
                x, own, cell = np.concatenate(vectors), np.concatenate(ids), np.array(cells)
            for at in range(0, len(got), 256):
                q, asked = got[at : at + 256], part[2].to_numpy()[at : at + 256]
                open_cells = np.zeros((len(q), cells_total), bool)
                for r, probe in enumerate(part[4].slice(at, 256).to_pylist()):
                    open_cells[r, probe] = True
                rough = np.where(open_cells[:, cell] & (own[None, :] != asked[:, None]), q @ x.T, -np.inf)
                kth = min(k, rough.shape[1])
                bar = np.partition(rough, -kth, axis=1)[:, -kth]
                with np.errstate(invalid="ignore"):
                    slack = 1e-9 * np.abs(np.where(np.isfinite(bar), bar, 0)) + 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
                r, c = np.nonzero((rough >= (bar - slack)[:, None]) & np.isfinite(rough))
                exact = products(q[r], x[c])
                yield _best([(asked[r], own[c], exact)], k)


def nearest_neighbours(
    vectors: DataFrame, k=K, every=EVERY, centroids=None, probed: float | None = None, recall=RECALL, sample=SAMPLE, unit=UNIT, seed=SEED
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for queries whose ``vec_id`` is divisible by ``every``.

    ``probed`` fixes the share of vectors that a query looks at; else that is fitted to ``recall``.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    sizes = sound.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return empty
    sound = sound.where(F.size("vector") == sizes["size"])
    draw = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, sample / sizes["count"])))
    rows = sorted((r["vec_id"], r["vector"]) for r in sound.where(draw).limit(2 * sample).toLocalIterator())
    fitted = np.array([v for _, v in rows] or [sound.first()["vector"]])
    split = sizes["size"] // 2
    centroids = centroids or int(np.clip(round((sizes["count"] / unit) ** 0.5), *CENTROIDS))
    halves = (fit_centroids(fitted[:, :split], centroids, seed=seed), fit_centroids(fitted[:, split:], centroids, seed=seed + 1))
    placed = materialize(
        arrow_map(sound, _assign, "vec_id long, vector binary, c1 int, c2 int", halves=spark.sparkContext.broadcast(halves)), "cells"
    )
    counts = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # centroids ** 2 rows at most
        counts[r["c1"], r["c2"]] = r["count"]
    if probed is None:
        probed = fitted_share(halves, fitted, counts, k, recall) if len(fitted) > 1 else 1.0
    index = spark.sparkContext.broadcast((halves, counts, *deal_units(counts, unit)))
    # rows that repeat a query ask once; their number is that of the vectors which can't be its neighbours
    asked = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    asked = asked.select("vec_id", "vector", F.lit(0).alias("c1"), F.lit(0).alias("c2"), "copies")
    rows = placed.withColumn("copies", F.lit(0).cast("long")).unionByName(asked)
    dealt = arrow_map(rows, _deal, ROW, index=index, probed=probed, k=k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "unit").sortWithinPartitions("unit", "kind")
    found = arrow_map(grouped, _rerank, "query_id long, vec_id long, score double", k=k, cells_total=counts.size)
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLES: dict[str, str] = {}

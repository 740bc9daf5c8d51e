"""Centroid clustering of whole-number vectors, exact, by filtering partition-local ball trees.

Vectors are put on a grid of whole numbers, so sums and squared distances are exact in any order and runs agree to the
digit. Each partition builds metric trees of at most ``TREE_ROWS`` of its vectors and writes them to the shared folder; a
node knows its radius, count and whole-number sum. In a round the trees are read again, and each is descended level by
level: a centroid that the triangle inequality shows to be farther than another from all of a ball is left out below it; a ball with
one centroid left goes to that as a whole, by its count and sum; at leaves, distances are computed exactly. Slack covers the rounding of
the bounds, so only clear cases are decided by them. A task sends ``k * (dimensions + 1)`` sums, whatever it holds.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part and give no row;
nor do vectors with a component beyond +-``LARGEST`` in absolute value, as no long holds their distances; a null ``vec_id`` is
clustered but never starts a centroid before one with an id; rows that repeat a ``vec_id`` are vectors of their own, and the smaller vector starts first; with fewer
vectors than centroids, there are as many centroids as vectors; equal starts leave the later one empty, where it is; an empty
table gives an empty result; a sum beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

DIMENSIONS = 64
GRID = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
TREE_ROWS = 4096
LEAF_ROWS = 32
LARGEST = 2**17
#: Whole numbers up to this one have exact products in double precision, summed over 64 components and more.
EXACT = 2**22


def on_grid(vectors: DataFrame, dimensions: int = DIMENSIONS, grid: int = GRID) -> DataFrame:
    """``vec_id`` and ``v``, whole numbers, of the vectors that take part."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= F.lit(float(LARGEST))))
    own = vectors.where(F.coalesce((F.size(x) == dimensions) & sound, F.lit(False)))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(grid)))).alias("v"))


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def ball_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of ``x``, and nodes before their children: range of rows in that order, right child (-1: a leaf), radius and sum."""
    order, starts, ends, rights, radii, sums = np.arange(len(x)), [], [], [], [], []

    def add(start: int, end: int) -> int:
        node, rows = len(starts), x[order[start:end]]
        total = rows.sum(axis=0)
        gap = rows - total / len(rows)
        far = np.einsum("ij,ij->i", gap, gap)
        for held, value in ((starts, start), (ends, end), (rights, -1), (radii, np.sqrt(far.max())), (sums, total)):
            held.append(value)
        if end - start > leaf_rows and far.max() > 0:
            # halves by projection on the line from the farthest row to the one farthest from that
            one = rows[far.argmax()]
            away = rows - one
            other = rows[np.einsum("ij,ij->i", away.astype(np.float64), away.astype(np.float64)).argmax()]
            along = away @ (other - one).astype(np.float64)
            order[start:end] = order[start:end][np.argsort(along, kind="stable")]
            half = (start + end) // 2
            add(start, half)
            rights[node] = add(half, end)
        return node

    add(0, len(x))
    nodes = {"start": np.array(starts), "end": np.array(ends), "right": np.array(rights), "radius": np.array(radii), "sum": np.array(sums, np.int64)}
    return order, nodes


_NODES = (("start", np.int32), ("end", np.int32), ("right", np.int32), ("radius", np.float64), ("sum", np.int64))
_TREE = "ids array<long>, rows binary, " + ", ".join(f"`{n}` binary" for n, _ in _NODES)


def _trees(batches, dimensions: int, rows: int, leaf_rows: int):
    """One row for each tree; a tree is made of rows as they come."""
    held: list[pa.RecordBatch] = []
    have = 0

    def made(part: pa.Table):
        x = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimensions)
        order, nodes = ball_tree(x, leaf_rows)
        ids = part.column("vec_id").take(pa.array(order)).to_pylist()
        small = np.abs(x).max() < 2**31
        binary = [pa.array([nodes[n].astype(t).tobytes()], pa.binary()) for n, t in _NODES]
        vectors = x[order].astype(np.int32 if small else np.int64).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([vectors], pa.binary()), *binary], names=["ids", "rows", *(n for n, _ in _NODES)]
        )

    for batch in batches:
        held.append(batch)
        have += batch.num_rows
        while have >= rows:
            whole = pa.Table.from_batches(held)
            yield made(whole.slice(0, rows))
            held = whole.slice(rows).to_batches()
            have -= rows
    if have:
        yield made(pa.Table.from_batches(held))


def _read(batch: pa.RecordBatch, i: int, dimensions: int, columns=tuple(n for n, _ in _NODES)) -> dict[str, np.ndarray]:
    kinds = dict(_NODES)
    nodes = {n: np.frombuffer(batch.column(n)[i].as_py(), kinds[n]) for n in columns}
    if "sum" in nodes:
        nodes["sum"] = nodes["sum"].reshape(-1, dimensions)
    return nodes


def _vectors(batch: pa.RecordBatch, i: int, n: int, dimensions: int) -> np.ndarray:
    data = batch.column("rows")[i].as_py()
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dimensions else np.int64).reshape(n, dimensions).astype(np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to whole-number centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and x.shape[1] <= 512:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)[None]).astype(np.int64)
    parts = [((x[i : i + 1024, None, :] - centroids[None]) ** 2).sum(axis=2) for i in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.zeros((0, len(centroids)), np.int64)


def descend(nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Balls that go to one centroid as a whole (nodes, their centroids) and leaves that are left to exact distances."""
    size = nodes["end"] - nodes["start"]
    center = nodes["sum"] / size[:, None]
    at, open_to = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    whole, owner, leaves = [], [], []
    while len(at):
        gap = center[at][:, None, :] - centroids[None]
        d = np.where(open_to, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)
        r = nodes["radius"][at][:, None]
        near = d.min(axis=1, keepdims=True)
        slack = 1e-6 + 1e-9 * (near + r)
        open_to = d - r <= near + r + slack
        alone = open_to.sum(axis=1) == 1
        whole.append(at[alone])
        owner.append(open_to[alone].argmax(axis=1))
        right = nodes["right"][at]
        leaves.append(at[~alone & (right < 0)])
        inner = ~alone & (right >= 0)
        at, open_to = np.concatenate((at[inner] + 1, right[inner])), np.concatenate((open_to[inner], open_to[inner]))
    return np.concatenate(whole), np.concatenate(owner), np.concatenate(leaves)


def _rows_of(nodes, which: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(nodes["start"][i], nodes["end"][i]) for i in which]) if len(which) else np.zeros(0, np.int64)


def _sums(batches, centroids, dimensions: int):
    """``cluster``, ``pos``, ``total``: sums of the components, and at ``pos`` -1 the count, of what each centroid gets."""
    centroids = centroids.value
    k = len(centroids)
    total = np.zeros((k, dimensions + 1), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            nodes = _read(batch, i, dimensions)
            whole, owner, leaves = descend(nodes, centroids)
            np.add.at(total[:, 1:], owner, nodes["sum"][whole])
            np.add.at(total[:, 0], owner, (nodes["end"] - nodes["start"])[whole].astype(np.int64))
            if len(leaves):
                x = _vectors(batch, i, int(nodes["end"][0]), dimensions)[_rows_of(nodes, leaves)]
                own = squared_distances(x, centroids).argmin(axis=1)
                for c in np.unique(own):
                    rows = x[own == c]
                    total[c, 0] += len(rows)
                    total[c, 1:] += rows.sum(axis=0)
    cluster, pos = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cluster.astype(np.int32)), pa.array((pos - 1).astype(np.int32)), pa.array(total[cluster, pos])], names=["cluster", "pos", "total"]
    )


def _assigned(batches, centroids, dimensions: int):
    centroids = centroids.value
    for batch in batches:
        for i in range(batch.num_rows):
            nodes = _read(batch, i, dimensions)
            n = int(nodes["end"][0])
            x = _vectors(batch, i, n, dimensions)
            cluster, distance = np.zeros(n, np.int32), np.zeros(n, np.int64)
            whole, owner, leaves = descend(nodes, centroids)
            for c in np.unique(owner):
                rows = _rows_of(nodes, whole[owner == c])
                cluster[rows], distance[rows] = c, squared_distances(x[rows], centroids[c : c + 1])[:, 0]
            rows = _rows_of(nodes, leaves)
            if len(rows):
                all_of = squared_distances(x[rows], centroids)
                cluster[rows], distance[rows] = all_of.argmin(axis=1), all_of.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").slice(i, 1).flatten(), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids at the floored means of what they got; those that got nothing stay."""
    total = {(r["cluster"], r["pos"]): r["total"] for r in sums.groupBy("cluster", "pos").agg(F.sum("total").alias("total")).collect()}
    rows = [
        [total.get((c, j), 0) // total[c, -1] for j in range(centroids.shape[1])] if (c, -1) in total else centroids[c].tolist()
        for c in range(len(centroids))
    ]
    return np.array(rows, np.int64)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k=CENTROIDS, rounds=ROUNDS, dimensions=DIMENSIONS, grid=GRID, seed=SEED, tree_rows=TREE_ROWS, leaf_rows=LEAF_ROWS
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster``, ``distance`` of each vector, and the centroids, for ``vectors`` with ``vec_id`` and ``embedding``."""
    sc = vectors.sparkSession.sparkContext
    points = on_grid(vectors, dimensions, grid)
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    trees = materialize(arrow_map(points, _trees, _TREE, dimensions=dimensions, rows=tree_rows, leaf_rows=leaf_rows), "ball-trees")
    for _ in range(rounds):
        found = arrow_map(trees, _sums, "cluster int, pos int, total long", centroids=sc.broadcast(centroids), dimensions=dimensions)
        after = moved(centroids, found)
        if (after == centroids).all():  # further rounds would repeat this one
            break
        centroids = after
    assigned = arrow_map(trees, _assigned, "vec_id long, cluster int, distance long", centroids=sc.broadcast(centroids), dimensions=dimensions)
    return materialize(assigned, "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distances of each cluster and of all summed, and the digest of each vector's centroid."""
    in_all = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    rows = {r["cluster"]: int(r["total"]) for r in in_all.collect()}  # one for each centroid
    fits = lambda n: n if n < 2**63 else None
    every = fits(sum(rows.values()))
    known = [(c, fits(n), every, centroid_digest(centroids[c])) for c, n in sorted(rows.items())]
    of = assigned.sparkSession.createDataFrame(known, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), F.col("cluster") == F.col("of")).drop("of")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """Rounds as one pair of tables each: ``c0``, ``a0``, ``c1``, ``a1``, ..."""
    gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = (
        "a{i} AS MATERIALIZED (SELECT r, min(p.vec_id) AS vec_id, any_value(p.v) AS v, arg_min(c.k, (d, c.k)) AS k, min(d) AS d\n"
        f"  FROM (SELECT p.r, p.vec_id, p.v, c.k, {gap} AS d FROM p, c{{i}} c) p, LATERAL (SELECT p.k AS k) c GROUP BY r)"
    )
    move = (
        "c{j} AS MATERIALIZED (SELECT k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (\n"
        "  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM (\n"
        "    SELECT k, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY k, pos\n"
        "  ) GROUP BY k) n USING (k))"
    )
    parts = [
        f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({GRID} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {LARGEST})) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM p ORDER BY h, v LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS):
        parts += [assign.format(i=i), move.format(i=i, j=i + 1)]
    parts.append(assign.format(i=ROUNDS))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _oracle()}

"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Exact copies of a vector are one class (equal label and equal components); one row of it goes on under a
number of its own, with the number of copies. Each class gets a key of ``bits`` signs in each of as many tables as
make the chance to miss a pair at the threshold ``MISS``. Classes that share a label and a key in
some table are compared by cosine in double precision, one matrix product for each bucket. A bucket
above ``TILE`` classes is split in tiles, and pairs of tiles are separate groups of rows, so no task
holds more than two tiles. Rows are dealt to buckets with the first ``CODE_BITS`` of their signs in place
of vectors; a pair at the threshold differs in more signs than :func:`reach` allows with probability
``MISS / 100``. Vectors join only rows that have a pair within reach which no earlier table in these signs holds.
A pair that meets in several tables counts in the first: the keys of those before are computed
again for rows that have links. A group gives each member one row: its number of new links and the
smallest member it is connected to. So links are counted in full, yet never listed pair by pair.

Defined results: a null vector or label, a zero vector, and one with null or non-finite components
link with nothing (0 links, their own component); vectors of different lengths never link; a null
``vec_id`` links with nothing and has a null component; rows that repeat a ``vec_id`` are vectors
of their own with that id, and the id alone links nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, by_group, connected_components, materialize, table

COSINE = 0.93
MISS = 1e-4
TILE = 192
#: Signs that rows carry to their buckets.
CODE_BITS = 192
SEED = 4_211


def usable(vector: str):
    """Whether a vector column has a direction: not null, not zero, all components finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def table_count(bits: int, cosine: float, miss: float) -> int:
    """Tables that leave a pair at ``cosine`` unfound with probability ``miss``."""
    same = 1 - math.acos(cosine) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(same**bits)))


def reach(n: int, cosine: float, miss: float) -> int:
    """The number of ``n`` signs that a pair at ``cosine`` exceeds in differences with probability ``miss`` at most."""
    p, tail, r = math.acos(cosine) / math.pi, 1.0, -1
    while tail > miss and r < n:
        r += 1
        tail -= math.comb(n, r) * p**r * (1 - p) ** (n - r)
    return r


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sides(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """For each row of ``x`` and each hyperplane of the tables, the side the row is on."""
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that products don't overflow
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((tables * bits, x.shape[1]))
    # summed in one order whatever the rows beside them, so that equal vectors have equal keys wherever they are
    return np.stack([(x * planes[k]).sum(axis=1) > 0 for k in range(tables * bits)], axis=1)


def keys_of(sides: np.ndarray, bits: int) -> np.ndarray:
    """One 32-bit number for each table, from the sides of its hyperplanes."""
    powers = (1 << np.arange(bits)).astype(np.uint32)
    return (sides.reshape(len(sides), -1, bits) @ powers).astype("<u4").view("<i4")


def signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Keys of the rows of ``x`` in each table."""
    return keys_of(sides(x, bits, tables, seed), bits)


def _signed(batches, bits: int, tables: int, seed: int):
    """Rows with ``keys`` of all tables and a ``code`` of their first signs in place of their vectors."""
    n = min(CODE_BITS, bits * tables)
    for big in batches:
        for at in range(0, big.num_rows, 2048):
            batch = big.slice(at, 2048)
            sizes = batch.column("size").to_numpy()
            keys = np.empty((batch.num_rows, tables), "<i4")
            codes = np.zeros((batch.num_rows, 8 * -(-n // 64)), np.uint8)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                found = sides(_matrix(batch.column("vector").take(pa.array(rows))), bits, tables, seed)
                keys[rows] = keys_of(found, bits)
                codes[rows, : -(-n // 8)] = np.packbits(found[:, :n], axis=1)
            offsets = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "label", "size")), lists, code], names=["rep", "label", "size", "keys", "code"]
            )


GROUP = ["label", "size", "nth", "key", "first", "second"]


def _of_group(near: np.ndarray, tile: np.ndarray, first: int, second: int) -> np.ndarray:
    """The pairs of a group that are its own: each pair once, of one tile with itself or of two tiles."""
    return near & (np.tri(len(near), k=-1, dtype=bool) if first == second else (tile == first)[:, None] & (tile == second)[None, :])


def _not_before(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of rows differ in the keys of all these tables."""
    return np.concatenate([~(keys[i[k : k + 8192]] == keys[j[k : k + 8192]]).any(axis=1) for k in range(0, len(i), 8192)])


def _within_reach(batches, most: int, bits: int, n: int):
    """Rows of a group that have a pair in it with at most ``most`` different signs, not in a table before as far as codes tell."""
    held: list[pa.Table] = []
    for group, rows in by_group(batches, GROUP):
        if rows.num_rows < 2:
            continue
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        apart = sum(np.bitwise_count(c[:, None] ^ c[None, :]).astype(np.uint16) for c in code.T)
        i, j = np.nonzero(_of_group(apart <= most, rows.column("tile").to_numpy(), group[4], group[5]))
        earlier = min(group[2], n // bits)
        if earlier and len(i):
            some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            found = np.unpackbits(np.ascontiguousarray(code[some]).view(np.uint8), axis=1)[:, : earlier * bits]
            new = _not_before(keys_of(found, bits), at[: len(i)], at[len(i) :])
            i, j = i[new], j[new]
        if len(i):
            held.append(rows.select([*GROUP, "rep", "tile"]).take(pa.array(np.unique(np.concatenate((i, j))))))
        if len(held) == 256:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _links(batches, cosine: float, bits: int, seed: int):
    """For each group ``rep``, ``n`` (copies newly linked) and ``root`` (smallest member connected)."""
    for group, rows in by_group(batches, GROUP):
        nth, first, second = group[2], group[4], group[5]
        if rows.num_rows < 2:
            continue
        own = _matrix(rows.column("vector"))
        v = own / np.abs(own).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        rep, copies, tile = (rows.column(c).to_numpy() for c in ("rep", "copies", "tile"))
        i, j = np.nonzero(_of_group(v @ v.T >= cosine, tile, first, second))
        if nth and len(i):
            # a pair counts in the first table in which it meets; only rows that have links need their keys of those before
            some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            new = _not_before(signs(own[some], bits, nth, seed), at[: len(i)], at[len(i) :])
            i, j = i[new], j[new]
        if not len(i):
            continue
        n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        root = rep.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            if (low == root).all():
                break
            root = low
        linked = n > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[linked]), pa.array(n[linked].astype(np.int64)), pa.array(root[linked])], names=["rep", "n", "root"]
        )


def embedding_duplicates(
    vectors: DataFrame, cosine=COSINE, miss=MISS, bits: int | None = None, tile=TILE, seed=SEED
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``."""
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.when(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("embedding")).alias("vector"),
    ).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    # one row for each distinct vector; ``rep`` numbers them, as rows that repeat a vec_id can have different vectors
    classes = materialize(
        own.where("vector is not null")
        .groupBy("label", "h1", "h2")
        .agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.min_by("vector", "vec_id").alias("vector"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vector-classes",
    )
    if bits is None:  # buckets stay of one size as vectors grow
        bits = max(6, math.ceil(math.log2(classes.count() + 1)) - 9)
    tables = table_count(bits, cosine, miss)
    sized = classes.select("rep", "label", F.size("vector").alias("size"), "vector")
    signed = materialize(
        arrow_map(sized, _signed, "rep long, label string, size int, keys array<int>, code binary", bits=bits, tables=tables, seed=seed), "signed"
    )
    place = ["label", "size", "nth", "key"]
    placed = signed.select("rep", "label", "size", "code", F.posexplode("keys").alias("nth", "key"))
    counted = materialize(placed.groupBy(*place).agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    tiled = (
        placed.join(counted, place)
        .withColumn("tiles", F.ceil(F.col("members") / tile).cast("int"))
        .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .withColumn("first", F.least("tile", "other"))
        .withColumn("second", F.greatest("tile", "other"))
        .select(*GROUP, "rep", "tile", "code")
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # pairs of tiles of one bucket go to partitions one after the other, so a large bucket is spread evenly
    part = F.pmod(F.pmod(F.xxhash64(*place), F.lit(parts)) + F.col("first") * 1009 + F.col("second"), F.lit(parts)).cast("int")
    n = min(CODE_BITS, bits * tables)
    grouped = "label string, size int, nth int, key int, first int, second int, rep long, tile int"
    near = materialize(
        arrow_map(
            tiled.repartitionById(parts, part).sortWithinPartitions(*GROUP), _within_reach, grouped,
            most=reach(n, cosine, miss / 100), bits=bits, n=n,
        ),
        "vectors-within-reach",
    )
    meeting = near.join(classes.select("rep", "copies", "vector"), "rep")
    found = materialize(
        arrow_map(
            meeting.repartitionById(parts, part).sortWithinPartitions(*GROUP), _links, "rep long, n long, root long",
            cosine=cosine, bits=bits, seed=seed,
        ),
        "vector-links",
    )
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "of")
    rooted = materialize(
        classes.join(linked, F.col("rep") == F.col("of"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("c_label"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), "lowest",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "rep").alias("comp"),
        ),
        "class-links",
    )
    lowest = materialize(rooted.groupBy(F.col("comp").alias("low_of")).agg(F.min("lowest").alias("root")), "lowest-ids")
    per_class = rooted.drop("lowest").join(lowest, F.col("comp") == F.col("low_of"))
    same = F.col("vector").isNotNull() & (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))
    component = F.coalesce("root", "vec_id")
    return own.join(per_class, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES = {
    "op2_embedding_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}
), r(vec_id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach
), c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id"""
}

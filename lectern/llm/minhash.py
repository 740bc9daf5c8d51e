"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is ``SYMBOLS`` minhashes cut to 16 bits. Two signatures are near if at most
``RADIUS`` symbols differ. The signature is split into chunks; with ``CHUNKS`` chunks and ``RADIUS``
differing symbols, the pigeonhole principle leaves some chunk with at most
``floor(RADIUS / CHUNKS)`` errors. Every way of leaving that many symbols of a chunk out is a key
(the allowed chunk errors, enumerated), so near signatures always meet under some key, whatever the data. At a Jaccard
similarity of 0.85 a pair exceeds the radius with probability below 1e-4, above it with less.

1. One pass over the texts: set size, a 128-bit digest of the set, the signature.
2. Equal sets are one class, found by grouping on the digest; one row of the class goes on under a number of its own.
3. Each bucket (chunk and key) links its members to its smallest member: a star, not all pairs. Star
   pairs within the radius and of possible sizes are confirmed on the full sets.
4. Buckets that hold more than one component are joined to groups of documents. Each group is compared
   in pairs of tiles of bounded size, by signature and size, and confirmed on the full sets; only tiles of like sizes
   meet: no link between different sets is lost, and only links that connect components are given out.
5. Components of the confirmed links; members of a class take its component.

Full sets come from a second reading of the texts, for documents that share a bucket only.

Defined results: a null or blank text has an empty set, size 0, and is linked with nothing; a text
with fewer words than a shingle is one shingle; a null ``doc_id`` is linked with nothing and is its
own component (null); rows that repeat a ``doc_id`` are documents of their own with that id, and the id alone
links nothing; only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, by_group, connected_components, materialize, slices, table

SHINGLE = 3
PERCENT = 85
SYMBOLS = 64
RADIUS = 21
CHUNKS = 11
SEED = 8_191
#: Documents of one tile; a group of rows to compare is two tiles at most.
TILE = 192

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle fingerprints of each text, sorted, end to end, and where each set starts."""
    import xxhash

    word_lists = [[] if t is None else t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in word_lists], dtype=np.int64)
    words = np.fromiter(
        (h for w in word_lists for h in map(xxhash.xxh3_64_intdigest, w)), dtype=np.uint64, count=int(counts.sum())
    )
    starts = np.concatenate(([0], np.cumsum(counts)))
    sets = []
    for start, n in zip(starts, counts):
        if not n:
            sets.append(words[:0])
            continue
        w = words[start : start + n]
        k = min(size, int(n))
        h = np.full(n - k + 1, np.uint64(n if n < size else size))
        for j in range(k):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j])
        sets.append(np.unique(h.view(np.int64)).view(np.uint64))
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else words[:0]), np.concatenate(([0], np.cumsum(lengths)))


def _signatures(values: np.ndarray, starts: np.ndarray, symbols: int, seed: int) -> np.ndarray:
    """Minhashes of nonempty sets, 16 bits each: one row for each set."""
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 2**63, symbols, dtype=np.uint64)
    factors = rng.integers(0, 2**62, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts) - 1, symbols), dtype="<u2")
    for i in range(symbols):
        low = np.minimum.reduceat((values ^ flips[i]) * factors[i], starts[:-1])
        out[:, i] = (_mixed(low) & np.uint64(0xFFFF)).astype("<u2")
    return out


SKETCH = "doc_id long, n_shingles long, digest binary, signature binary"


def _sketch(batches, shingle: int, symbols: int, seed: int):
    import xxhash

    for batch in slices(batches, "text"):
        values, starts = shingle_sets(batch.column("text").to_pylist(), shingle)
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        sigs = iter(_signatures(values, np.append(starts[full], starts[-1]), symbols, seed) if len(full) else [])
        digests, signatures = [], []
        for i, n in enumerate(sizes):
            digests.append(xxhash.xxh3_128_digest(values[starts[i] : starts[i + 1]].tobytes()) if n else None)
            signatures.append(next(sigs).tobytes() if n else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "signature"],
        )


def chunk_keys(symbols: int, radius: int, chunks: int) -> list[tuple[int, ...]]:
    """Positions that each key keeps: every chunk with every allowed number of its symbols left out."""
    from itertools import combinations

    errors = radius // chunks
    bounds = np.linspace(0, symbols, chunks + 1).round().astype(int)
    return [
        keep for a, b in zip(bounds, bounds[1:]) for keep in combinations(range(a, b), max(0, int(b - a) - errors))
    ]


def _keyed(batches, symbols: int, radius: int, chunks: int):
    """One row for each document and key: ``bucket`` is a hash of the key's number and its symbols."""
    keys = chunk_keys(symbols, radius, chunks)
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u2").reshape(-1, symbols).astype(np.uint64)
        out = np.empty((len(sigs), len(keys)), dtype=np.uint64)
        for k, keep in enumerate(keys):
            h = np.full(len(sigs), np.uint64(k + 1))
            for p in keep:
                h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, p])
            out[:, k] = h
        ids = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(out.reshape(-1).view(np.int64))], names=["rep", "bucket"]
        )


def _near(batches, symbols: int, radius: int, percent: int):
    """Pairs ``a``, ``b`` of rows whose signatures are within the radius and whose sizes allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, symbols)
            for c in ("sig_a", "sig_b")
        )
        n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        ok = ((left != right).sum(axis=1) <= radius) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _tile_links(batches, symbols: int, radius: int, percent: int):
    """Links in each pair of tiles that connect components: confirmed on full sets, nearest signatures first.

    Pairs already connected, also by links just found here, are not compared, so a tile gives fewer links
    than it has rows."""
    for (_, first, second), group in by_group(batches, ["group", "first", "second"]):
        group = group.combine_chunks()
        sigs = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype="<u2").reshape(-1, symbols)
        rep, comp, tile = (group.column(c).to_numpy() for c in ("rep", "comp", "tile"))
        lists = group.column("shingles").combine_chunks()
        values = lists.values.to_numpy()
        starts = lists.offsets.to_numpy()
        n, comp = np.diff(starts), comp.copy()
        left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        found: list[tuple[int, int]] = []
        for i in left:
            others = right[right > i] if first == second else right
            others = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            apart = (sigs[others] != sigs[i]).sum(axis=1)
            near = np.flatnonzero(apart <= radius)
            others = others[near[np.argsort(apart[near], kind="stable")]]
            mine, at, step = values[starts[i] : starts[i + 1]], 0, 8
            while at < len(others):
                some = others[at : at + step]
                some = some[comp[some] != comp[i]]
                at, step = at + step, min(4 * step, 512)
                if not len(some):
                    continue
                theirs = np.concatenate([values[starts[o] : starts[o + 1]] for o in some])
                hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(n[some])[:-1])))
                for o in some[100 * both >= percent * (n[some] + n[i] - both)]:
                    if comp[o] != comp[i]:
                        found.append((rep[i], rep[o]))
                        comp[comp == max(comp[o], comp[i])] = min(comp[o], comp[i])
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches, shingle: int):
    import xxhash

    for batch in slices(batches, "text"):
        values, starts = shingle_sets(batch.column("text").to_pylist(), shingle)
        sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
        digests = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), sets], names=["doc_id", "digest", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are at least ``percent`` similar."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, shingle=SHINGLE, percent=PERCENT, symbols=SYMBOLS, radius=RADIUS, chunks=CHUNKS, seed=SEED, tile=TILE
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(
        arrow_map(texts, _sketch, SKETCH, shingle=shingle, symbols=symbols, seed=seed), "sketches"
    )
    # one row for each distinct set; ``rep`` numbers them, as rows that repeat a doc_id can have different sets
    classes = materialize(
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest", "n_shingles")
        .agg(F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("lowest"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    reps = classes.select("rep", "n_shingles", "signature")
    keyed = arrow_map(
        reps, _keyed, "rep long, bucket long", symbols=symbols, radius=radius, chunks=chunks
    )
    buckets = keyed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(keyed.join(buckets, "bucket"), "buckets")

    def sides(pairs):
        a = reps.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a"), F.col("n_shingles").alias("n_a"))
        b = reps.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b"), F.col("n_shingles").alias("n_b"))
        return pairs.join(a, "a").join(b, "b")

    bounds = {"symbols": symbols, "radius": radius, "percent": percent}
    stars = shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star_pairs = materialize(arrow_map(sides(stars), _near, "a long, b long", **bounds), "star-pairs")
    # Full sets of classes that share a bucket: they grow with the table, so the joins are never broadcasts.
    sharing = materialize(
        classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("digest").alias("of_digest"), F.col("lowest").alias("of")),
        "sharing",
    )
    chosen = texts.join(sharing.hint("merge"), F.col("doc_id") == F.col("of"), "left_semi")
    chosen = chosen.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("doc_id", "text")
    read = arrow_map(chosen, _sets, "doc_id long, digest binary, shingles array<long>", shingle=shingle)
    same_set = (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("of_digest"))
    sets = materialize(read.join(sharing.hint("merge"), same_set).select("rep", "shingles"), "sets")
    links = materialize(_confirm(star_pairs, sets, percent), "links")
    roots = connected_components(links)

    # buckets in which not all are connected yet, in groups that share members
    placed = shared.join(roots, shared["rep"] == roots["node"], "left").select(
        "bucket", "rep", "pivot", F.coalesce("root", "rep").alias("comp")
    )
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    opened = placed.join(mixed.select("bucket"), "bucket", "left_semi").where("rep <> pivot")
    grouped = connected_components(opened.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    members = materialize(
        grouped.select(F.col("node").alias("rep"), F.col("root").alias("group"))
        .unionByName(grouped.select(F.col("root").alias("rep"), F.col("root").alias("group")).distinct())
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("rep", "group", F.coalesce("root", "rep").alias("comp")),
        "open-members",
    )
    # Sets can be similar only if they are of one class of sizes or of adjacent ones; a class is cut in tiles by hash.
    step = F.floor(F.log(F.col("n_shingles")) / (1.001 * math.log(100 / min(percent, 99)))).cast("long")
    signed = members.join(reps.withColumn("step", step), "rep")
    tiles = materialize(
        signed.groupBy(F.col("group").alias("of"), F.col("step").alias("at")).agg(F.ceil(F.count("*") / tile).cast("long").alias("tiles")), "tiles"
    )
    own = tiles.select(F.col("of").alias("own_of"), F.col("at").alias("own_at"), F.col("tiles").alias("own_tiles"))
    number = lambda step, tile: (step * F.lit(2**32) + tile).cast("long")
    tiled = (
        signed.join(own, (F.col("group") == F.col("own_of")) & (F.col("step") == F.col("own_at")))
        .withColumn("tile", number(F.col("step"), F.pmod(F.xxhash64("rep"), F.col("own_tiles"))))
        .select("group", "rep", "comp", "signature", "step", "tile")
        .join(sets, "rep")
        .join(tiles, (F.col("group") == F.col("of")) & F.col("at").between(F.col("step") - 1, F.col("step") + 1))
        .withColumn("nth", F.explode(F.expr("sequence(0L, tiles - 1)")))
        .withColumn("other", number(F.col("at"), F.col("nth")))
        .withColumn("first", F.least("tile", "other"))
        .withColumn("second", F.greatest("tile", "other"))
        .select("group", "first", "second", "rep", "comp", "tile", "signature", "shingles")
    )
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # pairs of tiles of one group go to partitions one after the other, so a large group is spread evenly
    nth_of = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1))
    start = F.xxhash64("group", F.shiftright("first", 32), F.shiftright("second", 32))
    part = F.pmod(F.pmod(start, F.lit(n_parts)) + nth_of("first") * 1009 + nth_of("second"), F.lit(n_parts)).cast("int")
    dealt = tiled.repartitionById(n_parts, part).sortWithinPartitions("group", "first", "second")
    more = materialize(arrow_map(dealt, _tile_links, "a long, b long", **bounds), "more-links")
    roots = materialize(connected_components(links.unionByName(more)), "roots")

    # the smallest doc_id of each component
    rooted = classes.select("rep", "digest", "n_shingles", "lowest").join(roots, F.col("rep") == F.col("node"), "left")
    rooted = rooted.select("digest", F.col("n_shingles").alias("size"), "lowest", F.coalesce("root", "rep").alias("comp"))
    lowest = materialize(rooted.groupBy(F.col("comp").alias("of")).agg(F.min("lowest").alias("component_id")), "lowest")
    comp = materialize(
        rooted.join(lowest, F.col("comp") == F.col("of")).select("digest", "size", "component_id"), "class-components"
    )
    same = (sketches["digest"] == comp["digest"]) & (sketches["n_shingles"] == comp["size"]) & sketches["doc_id"].isNotNull()
    component = F.coalesce(comp["component_id"], sketches["doc_id"])
    return sketches.join(comp, same, "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_minhash": op8_minhash}
ORACLES: dict[str, str] = {}

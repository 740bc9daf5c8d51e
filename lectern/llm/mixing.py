"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a token target. Blocks of equal size are allocated to sources, and within a source
to its shards, by highest quotients ``weight / (2 * seats + 1)``. Each shard then lays its documents
out in a seeded order, cuts that stream into blocks, and takes its quota: whole rounds of the stream
first, then blocks from the start of the stream. A stream in seeded order makes its first blocks a
seeded choice; no list of blocks is ever made, so the work is one pass over documents.

Shards hold about ``shard_words`` words, so that a source with a third of all rows is many tasks.

Defined results: a null text has no words; a null source is a source of its own, sorted last; empty
documents take nothing; repeated rows are documents of their own, with any ``doc_id`` (null too), whose results don't depend on
how rows are dealt to tasks;
an empty table gives an empty result; columns beyond ``doc_id``, ``text`` and ``source`` are ignored
by ``mix_plan`` and kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, table, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 8
SHARD_WORDS = 32_768
#: Rounds of the search for a divisor, and divisors of each.
ROUNDS, WAYS = 3, 8
SEED = 20_240_131
#: Equal rows are numbered in parts of so many.
COPIES = 65_536


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` for a table of ``source``, ``size``: one row per source.

    Weights repeat over the sources in code-point order, null last. Targets are in proportion to the
    weights, held to ``most`` times the source's size, the excess shared out again by weight. That is
    ``least(most * size, level * weight)`` for one level, found by sorting sources by the level at which
    they fill up: the first source that doesn't fill up sets the level (later ones give lower ones). Windows here see one row per source, never documents.
    """
    cap = F.col("source_size") * F.lit(most)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = W.partitionBy()
    by_turn = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_fill = W.orderBy("fill", "turn")
    until_me = by_fill.rowsBetween(W.unboundedPreceding, -1)
    from_me = by_fill.rowsBetween(0, W.unboundedFollowing)
    turn = F.row_number().over(by_turn)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    leveled = (
        by_source.withColumn("turn", turn)
        .withColumn("weight", weight)
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everyone) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum(cap).over(until_me), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(from_me))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open_weight"))
        .withColumn("final", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everyone))
    )
    return leveled.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.least(cap, F.coalesce(F.col("final"), F.col("fill")) * F.col("weight")).alias("target"),
    )


def apportion(parties: DataFrame, group: str, rounds=ROUNDS, ways=WAYS) -> DataFrame:
    """``parties`` (``group``, ``party``, ``votes``, and ``seats`` of the whole group) with their ``quota``: Sainte-Laguë's.

    A party gets its seats by the highest quotients ``votes / (2 * seats + 1)``, ties to the smaller party. The divisor that
    gives a group its seats is searched for on sums, ``ways`` divisors at once; only the few seats that the last
    divisors disagree on are ranked, so a group of any size is never in one task.
    """
    seats_at = lambda d: F.floor(F.col("votes") / d + 0.5)
    total, n, most, seats = (F.col(c) for c in ("total", "n", "most", "seats"))
    bounds = parties.groupBy(group).agg(
        F.sum("votes").alias("total"), F.count("*").alias("n"), F.max("votes").alias("most"), F.max("seats").alias("seats")
    )
    none = 2.000001 * most + 1e-9
    bounds = bounds.select(
        F.col(group).alias("of"), "seats", F.greatest(F.lit(1e-12), total / (seats + n / 2 + 1)).alias("low"),
        F.when(seats > n / 2, F.greatest(F.lit(2e-12), F.least(none, total / (seats - n / 2)))).otherwise(none).alias("high"),
    )
    bounds = materialize(bounds, "divisors")
    same = F.col(group).eqNullSafe(F.col("of"))
    for _ in range(rounds):
        tried = [F.col("low") + (F.col("high") - F.col("low")) * (k / ways) for k in range(1, ways)]
        joined = parties.drop("seats").join(bounds, same)
        sums = joined.groupBy("of", "seats", "low", "high").agg(*[F.sum(seats_at(d)).alias(f"s{k}") for k, d in enumerate(tried)])
        low = F.greatest("low", *[F.when(F.col(f"s{k}") >= seats, d) for k, d in enumerate(tried)])
        high = F.least("high", *[F.when(F.col(f"s{k}") < seats, d) for k, d in enumerate(tried)])
        bounds = materialize(sums.select("of", "seats", low.alias("low"), high.alias("high")), "divisors")
    sure = F.when(F.col("votes") > 0, seats_at(F.col("high"))).otherwise(0).cast("long")
    likely = F.when(F.col("votes") > 0, seats_at(F.col("low"))).otherwise(0).cast("long")
    seated = materialize(parties.drop("seats").join(bounds, same).withColumn("sure", sure).withColumn("likely", likely), "sure-seats")
    open_seats = seated.groupBy(F.col("of").alias("open_of")).agg((F.max("seats") - F.sum("sure")).alias("open"))
    rivals = (
        seated.where("likely > sure")
        .withColumn("seat", F.explode(F.expr("sequence(sure, likely - 1)")))
        .withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.col("votes") / (2 * F.col("seat") + 1)), "party", "seat")))
        .join(open_seats, F.col("of").eqNullSafe(F.col("open_of")))
        .where("rank <= open")
        .groupBy(F.col("of").alias("won_by"), F.col("party").alias("winner"))
        .agg(F.count("*").alias("won"))
    )
    won = F.col("of").eqNullSafe(F.col("won_by")) & F.col("party").eqNullSafe(F.col("winner"))
    quota = (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("quota")
    return seated.join(rivals, won, "left").select(group, "party", "votes", quota)


def shard_quotas(shards: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """Blocks for each shard (``source``, ``shard``, ``words``) by highest quotients: ``quota``.

    All blocks of the targets go to sources by their targets, and those of a source to its shards by their words.
    """
    sources = targets.select(F.lit(0).alias("all"), F.col("source").alias("party"), F.col("target").alias("votes"))
    every = targets.agg(F.round(F.sum("target") / F.lit(block)).cast("long").alias("seats"))
    of_source = apportion(sources.join(F.broadcast(every)), "all").select(F.col("party").alias("of"), F.col("quota").alias("seats"))
    parties = shards.join(of_source, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", F.col("shard").alias("party"), F.col("words").alias("votes"), "seats"
    )
    found = apportion(parties, "source")
    return found.select("source", F.col("party").alias("shard"), F.col("votes").alias("words"), "quota")


def numbered_sizes(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``order`` for every row; equal rows are numbered, so each has an order of its own.

    The number goes by content and count alone, so the orders are the same however rows are dealt to tasks.
    """
    size = words_of(F.col("text"))
    content = F.xxhash64(F.lit(seed), "doc_id", "text"), F.xxhash64(F.lit(seed + 1), "text")
    rows = docs.select("doc_id", "source", size.alias("size"), content[0].alias("h1"), content[1].alias("h2"))
    equal = rows.groupBy("doc_id", "source", "size", "h1", "h2").agg(F.count("*").alias("copies"))
    some = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    first = F.col("part") * COPIES
    each = some.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)))
    return each.select("doc_id", "source", "size", F.xxhash64("h1", "h2", "copy").alias("order"))


def mix_plan(
    docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=SEED
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs``."""
    sizes = materialize(numbered_sizes(docs, seed), "sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    dealt = (
        sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("shard", F.pmod(F.xxhash64("order"), F.ceil((F.col("source_size") + 1) / F.lit(shard_words)).cast("long")))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    quotas = materialize(shard_quotas(materialize(shards, "shards"), targets, block), "quotas").select(
        F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), "words", "quota"
    )
    stream = W.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard"))
    blocks = F.ceil(F.col("words") / F.lit(block))
    rounds = F.when(blocks > 0, F.floor(F.least(F.col("quota"), 2 * blocks) / blocks)).otherwise(0)
    rest = (F.least(F.col("quota"), 2 * blocks) - rounds * blocks) * F.lit(block)
    begin = F.col("end") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("end"), rest) - begin)
    return (
        placed.join(quotas, same)
        .select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))
    )


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, to the nearest whole copy.

    Rows with equal id, source and size share what they are taken, in even parts.
    """
    plan = mix_plan(docs, **parameters).where("taken > 0")
    key, times, copy = (fresh(docs, x) for x in ("_mix_key", "_mix_times", "_mix_copy"))
    of_plan = F.xxhash64(F.col("doc_id").cast("string"), F.col("source").cast("string"), "size")
    copies = plan.groupBy(of_plan.alias(key)).agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(times))
    of_doc = F.xxhash64(F.col("doc_id").cast("string"), F.col("source").cast("string"), words_of(F.col("text")))
    taken = docs.withColumn(key, of_doc).join(copies.where(F.col(times) > 0), key)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}

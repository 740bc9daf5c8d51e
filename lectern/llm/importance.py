"""Target-distribution importance resampling over hashed word n-grams, their CRCs composed by algebra.

A feature is a run of 1 to ``n`` words joined by single blanks; its bucket is the CRC-32 of its UTF-8 bytes modulo
``buckets``. Each word's CRC is computed once. The CRC of ``a b`` follows from those of ``a`` and ``b``: appending a
string of ``k`` bytes multiplies the CRC before it by the GF(2) matrix of ``k`` zero bytes, so no n-gram string is ever
made. The matrices of 1, 2, 4, ... zero bytes come from each other by squaring.

Buckets of the raw and of the target texts are counted in each task before any shuffle: a task sends ``buckets``
numbers at most, so the table of gains has a fixed size and is broadcast. A second pass sums gains over each document.
The draw is by counts of equal scores: these give the score at which the quota is used up and how many documents lie
above each score; only documents from that score on are ranked, score by score.

Defined results: a null or empty text has no words and no features (weight 0); a null id is hashed as an empty one and
sorts after others of its score; rows that repeat an id share its random number and are ranked one by one; equal rows get
ranks of their own; with no target text gains follow from the corpus alone; an empty table gives an empty result; a text
of any length is counted whole, a batch of about a million bytes at a time; other columns, whatever their names, ride
along in ``row`` only if asked for.
"""

from __future__ import annotations

import math
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices, table

NGRAM = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Scores of one such step are summed together before documents above each score are counted.
STEP = 64
#: The polynomial of CRC-32, its bits in reflected order.
POLYNOMIAL = 0xEDB88320


def _word_bytes() -> bytes:
    """For each byte what it is in a word: letters A-Z in lower case, other word bytes themselves, the rest a blank."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))


_WORD_BYTES = _word_bytes()


def words_in(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; characters beyond ASCII consist of bytes from 0x80 on, so bytes decide."""
    return text.translate(_WORD_BYTES).split()


def _table_of(columns: list[int]) -> np.ndarray:
    """A matrix of 32 columns as what it makes of each byte at each of the four places."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for place in range(4):
        for bit in range(8):
            out[place] ^= np.where(values >> bit & 1, columns[8 * place + bit], 0).astype(np.uint32)
    return out


def _times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return matrix[0][crc & 255] ^ matrix[1][crc >> 8 & 255] ^ matrix[2][crc >> 16 & 255] ^ matrix[3][crc >> 24]


@cache
def zero_bytes(k: int) -> np.ndarray:
    """The matrix of ``2 ** k`` zero bytes."""
    if k:
        half = zero_bytes(k - 1)
        return _table_of(_times(half, _times(half, (1 << np.arange(32)).astype(np.uint32))).tolist())
    columns = [1 << i for i in range(32)]
    for _ in range(8):
        columns = [c >> 1 ^ (POLYNOMIAL if c & 1 else 0) for c in columns]
    return _table_of(columns)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs times the matrices of ``length`` zero bytes each."""
    crc = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        rows = np.flatnonzero(length >> k & 1)
        crc[rows] = _times(zero_bytes(k), crc[rows])
    return crc


def ngram_crcs(crc: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int):
    """Document and CRC of all runs of 1 to ``n`` words, from the words' CRCs, lengths and documents."""
    yield doc, crc
    start, run = np.arange(len(crc)), crc
    one, blank = np.ones(1, np.int64), np.uint32(crc32(b" "))
    for k in range(1, n):
        inside = start + k < len(crc)
        inside[inside] = doc[start[inside] + k] == doc[start[inside]]
        start, run = start[inside], run[inside]
        if not len(start):
            return
        last = start + k
        run = shift(shift(run, np.broadcast_to(one, run.shape)) ^ blank, length[last]) ^ crc[last]
        yield doc[start], run


def _features(texts: pa.Array, n: int):
    """Number of words of each text, and arrays of documents and CRCs of their features."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        found = words_in(text) if text else []
        counts[i] = len(found)
        words += found
    crc = np.fromiter(map(crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words)) if n > 1 else crc
    return counts, ngram_crcs(crc, length, np.repeat(np.arange(len(texts)), counts), n)


def _counted(batches, n: int, buckets: int):
    total = np.zeros(buckets, np.int64)
    for batch in slices(batches, "text"):
        for _, crc in _features(batch.column("text"), n)[1]:
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: features of all texts in each bucket that has any."""
    own = texts.select(F.col(text).cast("string").alias("text"))
    return arrow_map(own, _counted, "bucket int, n long", n=n, buckets=buckets).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds: a thousand times the logarithm of how much likelier the target has it."""
    s, t = sum(raw.values()), sum(target.values())
    ratio = [
        float(target.get(b, 0) + 1) * float(s + buckets) / (float(raw.get(b, 0) + 1) * float(t + buckets)) for b in range(buckets)
    ]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weighed(batches, gain, n: int):
    gain = gain.value
    for batch in slices(batches, "text"):
        words, found = _features(batch.column("text"), n)
        features, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for doc, crc in found:
            features += np.bincount(doc, minlength=len(words))
            ends = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
            firsts = np.searchsorted(doc, np.arange(len(words) + 1))  # documents stand in order
            total += ends[firsts[1:]] - ends[firsts[:-1]]
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        columns = [*(batch.column(c) for c in ("row", "id")), pa.array(words), pa.array(features), pa.array(weight)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "n_features", "weight"])


def _collected(counts: DataFrame) -> dict[int, int]:
    return {r["bucket"]: r["n"] for r in counts.collect()}  # ``buckets`` rows at most


def weights(docs: DataFrame, target: DataFrame, keep=("doc_id",), doc_id: str = "doc_id", n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``id``, ``n_words``, ``n_features``, ``weight``, ``score`` for every row of ``docs``."""
    gain = gains(_collected(bucket_counts(docs, n=n, buckets=buckets)), _collected(bucket_counts(target, n=n, buckets=buckets)), buckets)
    own = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    kind = own.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    found = arrow_map(own, _weighed, f"row {kind}, id long, n_words long, n_features long, weight long", gain=shared, n=n)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return found.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the ``percent`` of documents of enough words with the highest scores, null for others.

    A written table is expected, as it is read several times.
    """
    eligible = scored.where(F.col("n_words") >= least_words)
    # scores are whole numbers within about +-70,000, so these counts have a bound of their own
    levels = materialize(
        eligible.groupBy("score").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / STEP)), "score-counts"
    )
    quota = (levels.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1)
    steps = levels.groupBy("step").agg(F.sum("n").alias("in_step")).withColumn("above_step", F.coalesce(F.sum("in_step").over(above), F.lit(0)))
    within = W.partitionBy("step").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    placed = levels.join(steps, "step").withColumn("above", F.col("above_step") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    reached = materialize(placed.where(F.col("above") < quota).select(F.col("score").alias("of_score"), "above"), "drawn-scores")
    lowest = reached.agg(F.min("of_score")).first()[0]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_reach = F.coalesce((F.col("n_words") >= least_words) & (F.col("score") >= lowest), F.lit(False))
    order = W.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight")
    rank = (F.col("above") + F.row_number().over(order)).cast("long")
    ranked = scored.where(in_reach).join(reached, F.col("score") == F.col("of_score")).withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **parameters) -> DataFrame:
    """Documents with weight, score and the rank at which they are drawn towards the texts of ``target``."""
    return draw(materialize(weights(docs, target, **parameters), "importance"), percent, least_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance": op13_importance}
ORACLES = {
    "op13_importance": rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END)) AS t
), texts AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), tokens AS (
  SELECT target, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), counted AS (SELECT target, r, w, count(*) AS n FROM tokens GROUP BY ALL
), distinct_words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i:
      16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM distinct_words, crc_table
), placed AS (SELECT c.target, c.r, bucket, sum(c.n)::BIGINT AS n FROM counted c JOIN hashed USING (w) GROUP BY ALL
), by_bucket AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (target = 1), 0)::BIGINT AS t FROM placed GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (SELECT sum(s) + {BUCKETS} FROM by_bucket)::DOUBLE
    / ((s + 1)::DOUBLE * (SELECT sum(t) + {BUCKETS} FROM by_bucket)::DOUBLE)))::BIGINT AS gain FROM by_bucket
), weighed AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM placed JOIN gained USING (bucket) WHERE target = 0 GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE target = 0
), ranked AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS}
    ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS nth FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN nth <= (SELECT count(*) * {PERCENT} // 100 FROM scored WHERE n_features >= {LEAST_WORDS}) THEN nth END AS rank FROM ranked"""
}

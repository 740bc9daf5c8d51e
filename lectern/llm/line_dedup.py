"""Line dedup by site-relative frequency, with DataFrame functions only.

Within a host, a line's ratio is the number of pages that contain it over the host's pages. Lines
above the ratio are boilerplate and are dropped from each page. Lines are compared trimmed, by two
64-bit hashes, so that counting shuffles a few bytes for each line, never its text. Each page counts
a line once before any shuffle, and counts are summed before the shuffle, so a line on every page of
a hot host costs one row for each task.

The boilerplate of a host is at most ``lines per page / ratio`` hashes, held as one array for each
host. Pages meet it by host: Spark broadcasts that table when its size, known from the files just
written, is under ``spark.sql.autoBroadcastJoinThreshold``, and else shuffles and splits hot hosts.

Defined results: a null text stays null with 0 lines; blank lines count as lines, are never
boilerplate, and stay; pages of a null host form a host of their own; a line of a single page stays, so a host of one page loses nothing; repeated rows count as
pages of their own; other columns pass through untouched. With ``distinct``, pages of a host with equal texts count as
one page, so a group of exact copies doesn't make its own lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

RATIO = 0.08
#: A line of one page repeats nothing, whatever its share.
MIN_PAGES = 2


def _bare(line):
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _key(line):
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def host_boilerplate(pages: DataFrame, host: str, text: str, ratio=RATIO, min_pages=MIN_PAGES, distinct: bool = False) -> DataFrame:
    """``host``, ``lines`` (keys of its boilerplate): one row for each host that has any."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), _bare), lambda x: x != ""))
    keyed = pages.select(F.col(host).alias("host"), F.transform(lines, _key).alias("keys"), _key(F.col(text)).alias("page"))
    if distinct:
        keyed = materialize(keyed.groupBy("host", "page").agg(F.first("keys").alias("keys")), "distinct-pages")
    totals = keyed.groupBy("host").agg(F.count("*").alias("pages"))
    counted = keyed.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    many = counted.where(F.col("n") >= min_pages)
    return (
        many.join(totals, many["host"].eqNullSafe(totals["host"]))
        .drop(totals["host"])
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("lines"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio=RATIO, min_pages=MIN_PAGES, counts: bool = False, distinct: bool = False
) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    site, site_lines, left_over = fresh(pages, "_site"), fresh(pages, "_site_lines"), fresh(pages, "_kept")
    found = materialize(host_boilerplate(pages, host, text, ratio, min_pages, distinct), "boilerplate").select(
        F.col("host").alias(site), F.col("lines").alias(site_lines)
    )
    split = F.split(F.col(text), "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col(site_lines), _key(_bare(x))))
    # a column of its own, so that lines are hashed once for all that is said about them
    joined = pages.join(found, F.col(host).eqNullSafe(F.col(site)), "left").withColumn(left_over, F.when(F.col(site_lines).isNotNull(), kept))
    cleaned = F.when(F.col(site_lines).isNull(), F.col(text)).otherwise(F.array_join(left_over, "\n"))
    if counts:
        n = F.coalesce(F.size(split), F.lit(0)).cast("long")
        n = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n)
        left = F.when(F.col(site_lines).isNull() | F.col(text).isNull(), n).otherwise(F.size(left_over).cast("long"))
        return joined.select(*[cleaned.alias(c) if c == text else pages[c] for c in pages.columns], n.alias("n_lines"), (n - left).alias("n_dropped"))
    return joined.select(*[cleaned.alias(c) if c == text else pages[c] for c in pages.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their source as host: what is left of each text."""
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


OP9_SQL = rf"""
WITH l AS (
  SELECT rowid_ AS r, doc_id, source, text, pos, line,
         regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents))
), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source
), b AS (
  SELECT l.source, l.bare, count(DISTINCT l.r) AS n, any_value(t.pages) AS pages
  FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.bare <> '' GROUP BY l.source, l.bare
  HAVING count(DISTINCT l.r) >= {MIN_PAGES} AND count(DISTINCT l.r) > {RATIO} * any_value(t.pages)
)
SELECT l.doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.bare IS NULL), '') AS text
FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare
GROUP BY l.r, l.doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": OP9_SQL}

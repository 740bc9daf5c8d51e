"""From files and page items to document text.

Reading a PDF's layout needs a library that isn't part of Spark; ``extract_with`` takes any function
that does it and runs it over ``binaryFile`` rows in Arrow batches. All that follows it, from page items to
lines, pages, quality and fallbacks, is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import col, extraction_quality, file_date, first_given, first_match, let, text_confidence, trim

MEGABYTE = 1024 * 1024
#: Largest upload by reader.
MOST_BYTES = {"enhanced": 100 * MEGABYTE, "server": 50 * MEGABYTE, "advanced": 50 * MEGABYTE}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``modificationTime``, ``length``, ``content`` of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def reject_reason(mime, size, profile: str = "enhanced") -> Column:
    """Why a file is refused, null if it isn't: missing, not a PDF, empty, too large (a limit itself passes)."""
    m, n = col(mime), col(size)
    return (
        F.when(n.isNull(), "no file")
        .when(F.coalesce(m, F.lit("")) != "application/pdf", "not a PDF")
        .when(n <= 0, "empty file")
        .when(n > MOST_BYTES[profile], "file too large")
    )


def extract_with(files: DataFrame, extract: Callable[[bytes], list[list[dict]]]) -> DataFrame:
    """Page items of each file: ``path``, ``page``, ``pos``, ``str``, ``x``, ``y``, ``ok``.

    ``extract`` gives for each page its items with ``str``, ``x`` and ``y``. A page without items has one
    row with a null ``str``; a file that fails has page 0, not ok.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = extract(content)
                except Exception:  # whatever the reader raises, the file is reported, not the job failed
                    rows.append((path, 0, 0, None, None, None, False))
                    continue
                for number, items in enumerate(pages, 1):
                    rows += [(path, number, i, x["str"], float(x["x"]), float(x["y"]), True) for i, x in enumerate(items)]
                    if not items:
                        rows.append((path, number, 0, None, None, None, True))
            yield pd.DataFrame(rows, columns=["path", "page", "pos", "str", "x", "y", "ok"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, pos int, str string, x double, y double, ok boolean")


def page_text_joined(items: DataFrame) -> DataFrame:
    """Pages as their non-blank items joined by blanks: ``doc_id``, ``page``, ``text``."""
    kept = F.sort_array(F.collect_list(F.when(trim("str") != "", F.struct("pos", "str"))))
    return items.groupBy("doc_id", "page").agg(F.array_join(F.transform(kept, lambda i: i["str"]), " ").alias("text"))


def joined_pages(pages: DataFrame, failed: str = "") -> DataFrame:
    """Documents as their pages' texts in order, a blank line between, without marks: ``doc_id``, ``text``, ``pages``."""
    rows = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit(failed)).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("pages"))


def page_text_flow(items: DataFrame) -> DataFrame:
    """Pages in item order: a new line where y moves by more than 5, a blank where x leaves a gap over 10;
    then all white space is one blank."""
    order = W.partitionBy("doc_id", "page").orderBy("pos")
    moved = F.abs(F.col("y") - F.lag("y").over(order)) > 5
    gap = F.col("x") - F.lag("x").over(order) > 10
    lead = F.when(moved, "\n").when(gap, " ").otherwise("")
    rows = items.withColumn("_piece", F.concat(F.coalesce(lead, F.lit("")), F.coalesce("str", F.lit(""))))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_piece"))), lambda i: i["_piece"]), "")
    return rows.groupBy("doc_id", "page").agg(trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


def lines_of(items) -> Column:
    """A page's text by lines, from its items in order: a line ends where the rounded y moves by more than 3; lines go from top to bottom,
    equal heights as they came; then all white space is one blank."""

    def laid(solid):
        y = lambda i: F.floor(F.get(solid, i)["y"] + 0.5)
        starts = F.filter(F.sequence(F.lit(0), F.size(solid) - 1), lambda i: (i == 0) | (F.abs(y(i) - y(i - 1)) > 3))
        return F.when(F.size(solid) > 0, let(starts, lambda at: stacked(solid, y, at))).otherwise("")

    def stacked(solid, y, at):
        held = lambda i, n: F.slice(solid, i + 1, F.coalesce(F.get(at, n + 1), F.size(solid)) - i)
        line = lambda i, n: F.struct((-y(i)).alias("down"), n.alias("n"), F.array_join(F.transform(held(i, n), lambda x: x["str"]), " ").alias("text"))
        return F.array_join(F.transform(F.sort_array(F.transform(at, line)), lambda x: x["text"]), " ")

    text = let(F.filter(col(items), lambda i: i["str"].rlike(r"\S")), laid)
    return trim(F.regexp_replace(text, r"\s+", " "))


def page_text_lines(items: DataFrame) -> DataFrame:
    """Pages by lines (``lines_of``) from rows of items: ``doc_id``, ``page``, ``text``."""
    return items.groupBy("doc_id", "page").agg(lines_of(F.sort_array(F.collect_list(F.struct("pos", "str", "y")))).alias("text"))


# How each reader marks pages, empty ones and failed ones.
PAGE_MARKS = {
    "basic": ("--- Page {} ---\n", None, "--- Page {} (Processing Error) ---\n"),
    "advanced": ("=== Page {} ===\n", "=== Page {} (No Text) ===\n", "=== Page {} (Error) ===\n"),
    "enhanced": ("=== Page {} ===\n", "=== Page {} (No Content) ===\n", "=== Page {} (Error) ===\n"),
}


def assemble_pages(pages: DataFrame, profile: str = "enhanced", also: tuple[Column, ...] = ()) -> DataFrame:
    """Documents from ``doc_id``, ``page``, ``text``, ``ok``: marked text, counts, confidence, quality.

    A page that failed or has no text counts as failed, except that the basic reader leaves empty pages out. ``also``: more aggregates of the pages.
    """
    good, empty, failed = PAGE_MARKS[profile]
    blank = trim(F.coalesce("text", F.lit(""))) == ""
    number = F.col("page").cast("string")
    mark = lambda m: F.replace(F.lit("\n\n" + m), F.lit("{}"), number)
    part = F.when(~F.col("ok"), mark(failed)).when(blank, mark(empty) if empty else F.lit("")).otherwise(F.concat(mark(good), F.col("text")))
    rows = pages.withColumn("_good", F.col("ok") & ~blank).withColumn("_part", part).withColumn("_sure", text_confidence("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "_part"))), lambda i: i["_part"]), "")
    docs = rows.groupBy("doc_id").agg(
        trim(joined).alias("text"), F.count("*").alias("pages"), F.count_if("_good").alias("successful_pages"),
        F.count_if(~F.col("_good")).alias("failed_pages"),
        F.coalesce(F.avg(F.when(F.col("_good"), F.col("_sure"))), F.lit(0.0)).alias("confidence"), *also,
    )
    kind = "enhanced" if profile == "enhanced" else "advanced"
    return docs.withColumn("quality", extraction_quality("successful_pages", "pages", F.length("text"), F.col("confidence"), kind))


def server_text(content) -> Column:
    """Text found in raw bytes read as Latin-1: what stands between ``$$`` marks and in stream bodies."""
    raw = F.decode(col(content), "ISO-8859-1")
    marked = F.transform(F.regexp_extract_all(raw, F.lit(r"\$\$[^)]+\$\$"), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
    marked = F.array_join(F.filter(marked, lambda m: (F.length(m) > 2) & m.rlike("[a-zA-Z]")), " ")
    bodies = F.transform(
        F.regexp_extract_all(raw, F.lit(r"(?s)stream\s*.*?\s*endstream"), F.lit(0)), lambda m: F.regexp_replace(m, r"stream\s*|\s*endstream", "")
    )
    bodies = trim(F.regexp_replace(F.regexp_replace(F.array_join(bodies, " "), r"[^\x20-\x7E]", " "), r"\s+", " "))
    return trim(F.array_join(F.filter(F.array(marked, bodies), lambda p: F.length(p) > 10), "\n\n"))


def server_extract(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``text`` of each file, or a note that none was found, with its ``quality``."""
    found = server_text(content)
    note = F.concat(F.lit("No text could be extracted from "), F.col(name), F.lit("."))
    # a file without text counts as one with a note of some length
    quality = F.when((F.length(found) < 50) | (F.length(found) > 200), "medium").otherwise("low")
    return files.withColumn("quality", quality).withColumn("text", F.when(F.length(found) < 50, note).otherwise(found))


def plain_text(content) -> Column:
    """A file read as UTF-8 text."""
    return F.decode(col(content), "UTF-8")


def document_metadata(title, author, subject, name, created=None, modified=None) -> Column:
    """Title or file name, author or Unknown, subject or nothing; empty counts as missing. Dates, if given, as times, null where they can't be read."""
    dates = [file_date(x).alias(n) for x, n in ((created, "created"), (modified, "modified")) if x is not None]
    return F.struct(
        first_given(title, name).alias("title"), F.coalesce(first_given(author), F.lit("Unknown")).alias("author"),
        F.coalesce(col(subject), F.lit("")).alias("subject"), *dates,
    )


def with_fallbacks(*attempts) -> Column:
    """The first attempt that gave text: ``text`` and which one it was, numbered from 1; 0 for none."""
    texts = [F.nullif(trim(a), F.lit("")) for a in attempts]
    which = first_match([(t.isNotNull(), i) for i, t in enumerate(texts, 1)], 0)
    return F.struct(F.coalesce(*texts, F.lit("No text could be extracted.")).alias("text"), which.alias("attempt"))


def normalize_embedding(payload) -> Column:
    """An embedding from a JSON reply: numbers, a list of them (the first), or an object that holds one.

    Null unless it has numbers and all are finite.
    """
    p = col(payload)
    flat = F.from_json(p, "array<double>")
    nested = F.get(F.from_json(p, "array<array<double>>"), F.lit(0))
    held = F.from_json(F.get_json_object(p, "$.embedding"), "array<double>")
    found = F.when(p.rlike(r"^\s*\{"), held).when(p.rlike(r"^\s*\[\s*\["), nested).otherwise(flat)
    sound = (F.size(found) > 0) & F.forall(found, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, found)


def html_fields(html) -> Column:
    """Title and first heading of an HTML page."""
    h = col(html)
    return F.struct(
        F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, r"<h1>([^<]*)</h1>", 1).alias("heading")
    )


def migrate_settings(state, providers: list[str], default: str) -> Column:
    """Settings JSON as version 1: a provider that isn't known becomes the default."""
    parsed = F.from_json(col(state), "version int, provider string, model string")
    known = F.when(parsed["provider"].isin(providers), parsed["provider"]).otherwise(F.lit(default))
    return F.struct(F.lit(1).alias("version"), known.alias("provider"), parsed["model"].alias("model"))


def ingest_progress(page, pages, start: int = 30, span: int = 50) -> Column:
    return F.lit(start) + F.lit(span) * col(page) / col(pages)

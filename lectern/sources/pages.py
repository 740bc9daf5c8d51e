"""Files read page by page: a page that fails is set apart, the others stay; a file of which nothing can be read leaves a record that says so.

The reader of a file format is two functions: one that gives a file's pages, one that gives a page's items. They run over Arrow
batches of the bytes, one row a page; an exception ends only that page, or the file if its pages can't be told.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import extraction_quality

from .documents import assemble_pages, lines_of, server_text

ITEMS = "array<struct<str:string,x:double,y:double>>"
#: Files whose pages are in a task's memory at one time.
FILES_AT_ONCE = 64
#: Least characters of server text that count as text.
LEAST_SERVER_TEXT = 50
# What the record of a file that can't be read says.
FALLBACK = {"author": "Enhanced PDF Processor", "subject": "Processing failed - fallback content", "method": "Enhanced Fallback", "quality": "low", "language": "English"}
WARNINGS = ("PDF processing failed", "Using structured fallback content")


def pages_in(content: bytes | None, pages_of: Callable[[bytes], Iterable], items_of: Callable[[object], Iterable[dict]]) -> Iterator[tuple]:
    """``page``, ``items``, ``problem`` of each page of a file. Page 0 is the file itself, if its pages can't be told."""
    try:
        pages = iter(pages_of(content))
    except Exception as e:
        yield 0, None, f"{type(e).__name__}: {e}"
        return
    number = 0
    while True:
        number += 1
        try:
            page = next(pages)
        except StopIteration:
            return
        except Exception as e:  # what comes from here on can't be told
            yield number if number > 1 else 0, None, f"{type(e).__name__}: {e}"
            return
        try:
            items = [(i["str"], float(i["x"]), float(i["y"])) for i in items_of(page)]
        except Exception as e:
            yield number, None, f"{type(e).__name__}: {e}"
        else:
            yield number, items, None


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except (pa.ArrowException, UnicodeError):  # something else than texts, or halves of characters
        return pa.array([None if v is None else str(v).encode("utf-8", "replace").decode() for v in values], pa.string())


def read_pages(files: DataFrame, pages_of: Callable, items_of: Callable, content: str = "content") -> DataFrame:
    """``files`` without their bytes, one row for each page: ``page``, ``items``, ``problem``."""
    kept = [c for c in files.columns if c != content]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.schema.fields if f.name != content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, FILES_AT_ONCE):
                batch = big.slice(at, FILES_AT_ONCE)
                of, numbers, problems, ends, items = [], [], [], [0], []
                for i, data in enumerate(batch.column(content).to_pylist()):
                    for number, found, problem in pages_in(data, pages_of, items_of):
                        of.append(i)
                        numbers.append(number)
                        problems.append(problem)
                        items += found or ()
                        ends.append(len(items))
                strs, xs, ys = zip(*items) if items else ((), (), ())
                flat = pa.StructArray.from_arrays([_texts(list(strs)), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], names=["str", "x", "y"])
                failed = pa.array([p is not None for p in problems], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=failed)
                columns = [batch.column(c).take(pa.array(of, pa.int64())) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), lists, _texts(problems)], names=[*kept, "page", "items", "problem"])

    return files.mapInArrow(run, f"{fields}page int, items {ITEMS}, problem string")


def quarantine(pages: DataFrame) -> DataFrame:
    """Pages that failed, with their problem; page 0 stands for a whole file."""
    return pages.where("problem is not null").select("doc_id", "page", "problem")


def page_texts(pages: DataFrame, layout: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id``, ``page``, ``text``, ``ok``, ``problem`` of read pages; a page without items, or one that failed, has an empty text.

    A page's items lie in its row, so lines are laid out there; a ``layout`` of rows of items shuffles them all.
    """
    ok = F.col("problem").isNull()
    if layout is None:
        return pages.select("doc_id", "page", F.when(ok & (F.size("items") > 0), lines_of("items")).otherwise("").alias("text"), ok.alias("ok"), "problem")
    some = pages.where(ok & (F.size("items") > 0)).select("doc_id", "page", F.posexplode("items").alias("pos", "item")).select("doc_id", "page", "pos", "item.*")
    none = pages.where(~ok | (F.coalesce(F.size("items"), F.lit(0)) <= 0)).select("doc_id", "page", F.lit("").alias("text"), ok.alias("ok"), "problem")
    texts = layout(some).select("doc_id", "page", "text", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("problem"))
    return texts.unionByName(none)


def fallback_text(name: Column, size: Column, problem: Column) -> Column:
    """The text of a file of which nothing could be read."""
    return F.concat(
        F.lit("# PDF Processing Report: "), name, F.lit("\n\n## Processing Status: FAILED\n\n**Error**: "), problem,
        F.lit("\n**File Size**: "), F.format_string("%.2f", size / (1024 * 1024)), F.lit(" MB\n"),
    )


def read_documents(files: DataFrame, pages_of: Callable, items_of: Callable, layout: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of ``files`` (``doc_id``, ``name``, ``size``, ``content``), one for each, and the quarantine of their pages.

    The first way that gives text counts: pages as read (``Enhanced``), text found in the raw bytes (``Server``), the record of
    the failure. The server's way is tried for files without a good page only. Each result reads the files once; cache them if that is dear.
    """
    pages = read_pages(files.select("doc_id", "content"), pages_of, items_of)
    # page 0 is the only one of its file, which thus has no good page
    first = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("page"))).alias("problem")
    read = F.coalesce(F.col("successful_pages") > 0, F.lit(False))
    joined = files.join(assemble_pages(page_texts(pages, layout), also=(first,)), "doc_id", "left").withColumn("server", F.when(~read, server_text("content"))).drop("content")
    by_server = F.coalesce(F.length("server") >= LEAST_SERVER_TEXT, F.lit(False))
    problem = F.coalesce("problem", F.lit("Unknown error"))
    chosen = lambda pages, server, none: F.when(read, pages).when(by_server, server).otherwise(none)
    count = lambda c, server, none: chosen(F.col(c), F.lit(server), F.lit(none)).cast("long").alias(c)
    some_warned = F.when(F.col("failed_pages") > 0, F.array(F.concat(F.col("failed_pages").cast("string"), F.lit(" pages failed to process")))).otherwise(
        F.array().cast("array<string>")
    )
    docs = joined.select(
        "doc_id",
        chosen(F.col("text"), F.col("server"), fallback_text(F.col("name"), F.col("size"), problem)).alias("text"),
        chosen(F.lit("Enhanced"), F.lit("Server"), F.lit(FALLBACK["method"])).alias("method"),
        count("pages", 1, 1), count("successful_pages", 1, 0), count("failed_pages", 0, 1),
        chosen(F.col("confidence"), F.lit(None).cast("double"), F.lit(0.0)).alias("confidence"),
        chosen(F.col("quality"), extraction_quality(F.lit(1), F.lit(1), F.length("server"), F.lit(0.0), "advanced"), F.lit(FALLBACK["quality"])).alias("quality"),
        chosen(some_warned, F.array().cast("array<string>"), F.array(F.lit(WARNINGS[0]), problem, F.lit(WARNINGS[1]))).alias("warnings"),
        chosen(F.lit(None), F.lit(None), F.lit(FALLBACK["author"])).alias("author"),
        chosen(F.lit(None), F.lit(None), F.lit(FALLBACK["subject"])).alias("subject"),
    )
    return docs, quarantine(pages)

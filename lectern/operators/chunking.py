"""Chunkers: folds over words or paragraphs of one text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import col, first_match, let, single_blanks, total, trim, words

_OUT = "array<string>"


def pack_words(text, size: int = 1000) -> Column:
    """Words packed greedily into chunks of at most ``size`` characters; a longer word is a chunk.

    One pass of one pattern over the text with single blanks: the longest run of whole words that fits, else one word.
    """
    return F.regexp_extract_all(single_blanks(text), F.lit(rf"(?s)[^ ].{{0,{max(size, 1) - 1}}}(?<=[^ ])(?= |\z)|[^ ]+"), F.lit(0))


def chunk_pages(text, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks of a page-marked text: pages packed apart, certificates whole, each chunk led by the last
    two lines of the one before it."""
    pages = F.filter(F.transform(F.split(col(text), r"--- Page \d+ ---"), trim), lambda p: p != "")
    packed = F.flatten(
        F.transform(
            pages,
            lambda p: F.when(F.contains(p, F.lit("certificate")) | F.contains(p, F.lit("awarded to")), F.array(p)).otherwise(
                pack_words(p, size)
            ),
        )
    )
    if overlap <= 0:
        return packed

    def tail(chunk):
        lines = F.filter(F.split(chunk, "\n"), lambda line: line.rlike(r"\S"))
        return let(lines, lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - 1, F.lit(1)), F.lit(2)), "\n"))

    return let(
        packed,
        lambda p: F.transform(p, lambda c, i: F.when(i == 0, c).otherwise(F.concat(tail(F.get(p, i - 1)), F.lit("\n"), c))),
    )


def paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), trim), lambda p: p != "")


def end_paragraph(text, last: bool = False) -> Column:
    """The first or last of ``paragraphs``, null without any; only this one is trimmed."""
    bare, at = trim(text), r"\n\s*\n"
    return F.nullif(trim(F.element_at(F.split(bare, at), -1) if last else F.get(F.split(bare, at, 2), F.lit(0))), F.lit(""))


def sentence_overlap(text, overlap: int) -> Column:
    """Last sentences of a text, each with its full stop, until they reach the wanted length."""
    pieces = F.reverse(F.split(text, r"[.!?]+"))

    def step(held, s, target):
        longer = let(trim(s), lambda t: F.when(t == "", held).otherwise(F.concat(t, F.lit(". "), held)))
        return F.when(F.length(held) >= target, held).otherwise(longer)

    target = F.least(F.lit(overlap), F.length(text) / 2)
    return trim(let(target, lambda n: F.aggregate(pieces, F.lit(""), lambda held, s: step(held, s, n))))


def chunk_paragraphs(text, size: int = 1000, overlap: int = 150) -> Column:
    """Paragraphs joined up to ``size`` characters; a chunk begins with the last sentences of the one before."""
    start = F.struct(F.array().cast(_OUT).alias("out"), F.lit("").alias("cur"))

    def step(s, p):
        full = (F.length(s["cur"]) + F.length(p) > size) & (s["cur"] != "")
        ended = F.struct(F.concat(s["out"], F.array(s["cur"])).alias("out"), F.concat(sentence_overlap(s["cur"], overlap), p).alias("cur"))
        longer = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        return F.when(full, ended).otherwise(F.struct(s["out"].alias("out"), longer.alias("cur")))

    folded = F.aggregate(
        paragraphs(text), start, step, lambda s: F.when(trim(s["cur"]) != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])
    )
    return F.transform(folded, trim)


def chunk_windows(text, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, ``overlap`` shared, up to the one that reaches the end."""
    if size <= 0:
        return F.array(col(text))
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    n, step = F.length(col(text)), size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(col(text), i * step + 1, F.lit(size)))
    return F.when(n > 0, windows).otherwise(F.array().cast(_OUT))


def adaptive_size(text) -> Column:
    """``size`` and ``overlap`` by length of the text."""
    n = F.length(col(text))
    size = first_match([(n > 20000, 1000), (n > 10000, 800), (n > 5000, 600)], 400)
    size = F.greatest(F.lit(300), F.least(F.lit(1200), size))
    return F.struct(size.alias("size"), F.floor(size * 0.1).cast("int").alias("overlap"))


def chunk_adaptive(text) -> Column:
    """Page chunks whose size follows the length of the text."""
    n = F.length(col(text))
    return F.when(n > 20000, chunk_pages(text, 1000)).when(n > 10000, chunk_pages(text, 800)).when(n > 5000, chunk_pages(text, 600)).otherwise(chunk_pages(text, 400))


def chunk_type(content) -> Column:
    c = col(content)
    return first_match(
        [
            ((F.length(c) < 50) & trim(c).rlike(r"^[A-Z][^.!?]*$"), "heading"),
            (F.contains(c, F.lit("•")) | F.contains(c, F.lit("-")) | c.rlike(r"^\d+\."), "list"),
            (F.contains(c, F.lit("|")) | F.contains(c, F.lit("\t")), "table"),
            ((F.length(c) > 50) & F.contains(c, F.lit(".")), "paragraph"),
        ],
        "other",
    )


def chunk_confidence(content) -> Column:
    c = col(content)
    add = [(F.length(c) > 100, 20), (F.contains(c, F.lit(".")), 10), (c.rlike("[A-Z]"), 10), (F.size(words(c)) > 10, 10)]
    return F.least(F.lit(100), F.lit(50) + total([F.when(cond, v).otherwise(0) for cond, v in add]))


def exploded(docs: DataFrame, chunks, *keep) -> DataFrame:
    """``keep``, ``chunk_index``, ``content``: one row for each chunk, none for a text without.

    Not ``posexplode``: Spark puts filters on the array before that, for which each text is cut again.
    """
    return docs.select(*keep, F.posexplode_outer(chunks).alias("chunk_index", "content")).where("content is not null")


def chunk_rows(docs: DataFrame, chunks: Column, text: str = "text") -> DataFrame:
    """One row for each chunk: ``chunk_index``, ``content``, offsets, word count, type and confidence.

    ``start_char_ref`` is where the text's first paragraph starts, the offset that every chunk carries
    in the interface this follows; ``start_char`` is where the chunk's last paragraph's text occurs.
    """
    # what belongs to the text is found once, not for each of its chunks
    begun = docs.withColumn("_begin", F.instr(F.col(text), end_paragraph(text)) - 1)
    rows, begin = exploded(begun, chunks, "*"), F.col("_begin")
    tail = end_paragraph("content", last=True)
    return rows.select(
        *docs.columns, "chunk_index", "content",
        begin.alias("start_char_ref"),
        (begin + F.length("content")).alias("end_char_ref"),
        # most texts don't hold a paragraph led by sentences of the chunk before: a search by bytes tells, before one by characters
        (F.when(F.contains(F.col(text), tail), F.instr(F.col(text), tail)).when(tail.isNotNull(), 0) - 1).alias("start_char"),
        F.size(words("content")).alias("word_count"),
        chunk_type("content").alias("type"),
        chunk_confidence("content").alias("confidence"),
    )


def vector_rows(docs: DataFrame, doc_id: str = "doc_id", name: str = "name") -> DataFrame:
    """Chunks and embeddings zipped by position: one row each, a missing embedding is empty."""
    zipped = docs.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("source"), F.posexplode(F.arrays_zip("chunks", "embeddings")).alias("chunk_index", "pair"))
    rows = zipped.where(F.col("pair.chunks").isNotNull())
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "source", "chunk_index", F.col("pair.chunks").alias("content"),
        F.coalesce("pair.embeddings", F.array().cast("array<double>")).alias("embedding"),
    )

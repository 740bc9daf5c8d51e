"""Exports of documents, libraries, chats and sessions as text columns, and as rows of files (see ``sources.file_export``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import col, file_size


# Fixed values in what follows: the headings and marks of exported files.


def bare_name(name) -> Column:
    """A file name without its PDF ending, whatever its case."""
    return F.regexp_replace(col(name), r"(?i)\.pdf$", "")


def chunks_markdown(name, chunks, exported) -> Column:
    """All chunks of a document under numbered headings."""
    c = col(chunks)
    parts = F.transform(c, lambda x, i: F.concat(F.lit("## Chunk "), (i + 1).cast("string"), F.lit("\n\n"), x, F.lit("\n\n---\n\n")))
    head = F.concat(
        F.lit("# Document Chunks: "), col(name), F.lit("\n\nExported: "), col(exported), F.lit("\nTotal Chunks: "), F.size(c).cast("string"), F.lit("\n\n---\n\n")
    )
    return F.concat(head, F.array_join(parts, ""))


def document_json(*fields: str, exported=None, pretty: bool = False) -> Column:
    """A document's fields as JSON, with the time of export if given."""
    parts = [F.struct(*fields).alias("document"), *([col(exported).alias("exportedAt")] if exported is not None else [])]
    return F.to_json(F.struct(*parts), {"pretty": "true"} if pretty else {})


# How files of a document are named, by format.
ENDINGS = {"txt": "_extracted.txt", "json": "_data.json", "chunks": "_chunks.md"}


def document_files(docs: DataFrame, format: str, exported) -> DataFrame:
    """``name``, ``content`` of one file for each document (``doc_id``, ``name``, ``content``, ``chunks``): its text, its data or its chunks."""
    name = bare_name("name")
    contents = {
        "txt": lambda: F.coalesce("content", F.lit("")),
        "json": lambda: document_json(F.col("doc_id").alias("id"), "name", "content", "chunks", exported=exported, pretty=True),
        "chunks": lambda: chunks_markdown("name", "chunks", exported),
    }
    return docs.select(F.concat(name, F.lit(ENDINGS[format])).alias("name"), contents[format]().alias("content"))


def library_json(docs: DataFrame, method="method", confidence="confidence", quality="quality") -> DataFrame:
    """A JSON object for each document of a library, with how it was processed: rows of a JSON-lines file, so no row holds the library."""
    stats = F.struct(F.col(method).alias("method"), F.col(confidence).alias("confidence"), F.coalesce(quality, F.lit("unknown")).alias("quality"))
    return docs.select(
        "doc_id",
        F.to_json(
            F.struct(
                F.col("doc_id").alias("id"), "name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("type", F.lit("unknown")).alias("type"),
                F.coalesce("chunks", F.array()).alias("chunks"), stats.alias("processingStats"),
            )
        ).alias("json"),
    )


def html_escaped(text) -> Column:
    return F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def chat_html(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text", title: str = "Chat Export") -> DataFrame:
    """Each conversation as an HTML page to print: ``html``. Texts are escaped; line ends become breaks."""
    body = F.replace(html_escaped(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"), F.lit("<br>"))
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    entry = F.concat(
        F.lit('<div class="message '), html_escaped(F.coalesce("role", F.lit(""))), F.lit('"><h3>'), who, F.lit("</h3><p>"), body, F.lit("</p></div>\n")
    )
    head = f"<!DOCTYPE html>\n<html>\n<head><title>{title}</title></head>\n<body>\n<h1>{title}</h1>\n"
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, entry.alias("entry")))), lambda x: x["entry"])
    return messages.groupBy(by).agg(F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</body>\n</html>\n")).alias("html"))


def library_entry(number, name, size, kind, n_chunks, first_chunk) -> Column:
    """One document of a library listing, with the first 200 characters of its first chunk."""
    preview = F.when(col(n_chunks) > 0, F.concat(F.lit("### Content Preview:\n\n"), F.substring(col(first_chunk), 1, 200), F.lit("...\n\n"))).otherwise("")
    return F.concat(
        F.lit("## "), col(number).cast("string"), F.lit(". "), col(name), F.lit("\n\n- **Size:** "), file_size(size), F.lit("\n- **Type:** "),
        F.coalesce(col(kind), F.lit("unknown")), F.lit("\n- **Chunks:** "), col(n_chunks).cast("string"), F.lit("\n\n"), preview, F.lit("---\n\n"),
    )


def chat_markdown(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each conversation as Markdown: ``markdown``. A conversation is one row, as long as its turns."""
    entry = F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n\n---\n\n"))
    return messages.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, entry.alias("entry")))), lambda x: x["entry"]), "").alias("markdown")
    )


def chat_text(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each conversation as plain text: ``plain``."""
    entry = F.concat(F.upper("role"), F.lit(":\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n\n"), F.lit("=" * 50), F.lit("\n\n"))
    return messages.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, entry.alias("entry")))), lambda x: x["entry"]), "").alias("plain")
    )


def share_preview(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text", last: int = 10, shown: int = 3) -> DataFrame:
    """For each conversation how many of its last messages are shared, the last few cut to 100 characters,
    and a link's base64 of them all."""
    newest = W.partitionBy(by).orderBy(F.desc(order))
    x = F.coalesce(F.col(text), F.lit(""))
    cut = F.concat(F.when(F.col("role") == "user", "U: ").otherwise("A: "), F.substring(x, 1, 100), F.when(F.length(x) > 100, "...").otherwise(""))
    recent = messages.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= last).withColumn("_cut", cut)
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_nth").alias("n"), F.col("_cut").alias("c"))))
    shown_rows = F.transform(F.filter(rows, lambda r: r["n"] <= shown), lambda r: r["c"])
    payload = F.to_json(F.transform(rows, lambda r: r["c"]))
    return recent.groupBy(by).agg(F.count("*").alias("shared"), F.array_join(shown_rows, "\n").alias("preview"), F.base64(F.encode(payload, "UTF-8")).alias("link"))


def chat_json(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each conversation as JSON: ``json``."""
    entry = F.struct(F.col(order).alias("id"), F.col("role"), F.col(text).alias("content"))
    rows = F.sort_array(F.collect_list(F.struct(order, entry.alias("entry"))))
    return messages.groupBy(by).agg(F.to_json(F.struct(F.transform(rows, lambda x: x["entry"]).alias("messages"))).alias("json"))

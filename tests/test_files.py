"""Pages that fail, files that can't be read, and exports whose tasks fail."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import export
from lectern.sources import documents, file_export, pages


def reader():
    """Functions of their own, as workers can't import this module."""

    def split(content: bytes):
        if content == b"broken":
            raise ValueError("no pages")
        for page in content.decode().split("\f"):
            if page == "cut":
                raise OSError("ends here")
            yield page

    def items(page: str):
        if "bad" in page:
            raise KeyError("font")
        return [{"str": w, "x": 10 * i, "y": 0} for i, w in enumerate(page.split())]

    return split, items


def test_a_bad_page_of_three_leaves_two(spark):
    contents = [b"one page\fbad page\fthree more", b"broken", b"first\fcut\fnever seen", b"bad", b"\f", b"a stream " + b"text in a body " * 9 + b"endstream bad", b"", None]
    files = spark.createDataFrame([(i, f"f{i}.pdf", 2_000_000, c) for i, c in enumerate(contents)], "doc_id long, name string, size long, content binary")
    docs, quarantined = pages.read_documents(files, *reader())
    found = {r["doc_id"]: r for r in docs.collect()}
    assert {(r["doc_id"], r["page"], r["problem"]) for r in quarantined.collect()} == {
        (0, 2, "KeyError: 'font'"), (1, 0, "ValueError: no pages"), (2, 2, "OSError: ends here"), (3, 1, "KeyError: 'font'"), (5, 1, "KeyError: 'font'"),
        (7, 0, "AttributeError: 'NoneType' object has no attribute 'decode'"),
    }
    assert (found[0]["method"], found[0]["successful_pages"], found[0]["failed_pages"]) == ("Enhanced", 2, 1)
    assert "one page" in found[0]["text"] and "three more" in found[0]["text"] and found[0]["warnings"] == ["1 pages failed to process"]
    assert found[2]["successful_pages"] == 1 and found[5]["method"] == "Server" and found[5]["text"].startswith("text in a body")
    for i, problem in ((1, "ValueError: no pages"), (3, "KeyError: 'font'"), (4, "Unknown error")):
        r = found[i]
        assert (r["method"], r["confidence"], r["quality"], r["failed_pages"]) == ("Enhanced Fallback", 0.0, "low", 1)
        assert r["warnings"] == ["PDF processing failed", problem, "Using structured fallback content"] and f"**Error**: {problem}" in r["text"] and "1.91 MB" in r["text"]
    assert len(found) == len(contents)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"first page\fsecond")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"not asked for")
    found = documents.read_files(spark, str(tmp_path), "*.pdf")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    docs, bad = pages.read_documents(found.select(name.alias("doc_id"), name.alias("name"), F.col("length").alias("size"), "content"), *reader())
    assert {r["doc_id"]: r["method"] for r in docs.collect()} == {"a.pdf": "Enhanced", "b.pdf": "Enhanced Fallback"}
    assert [(r["doc_id"], r["page"]) for r in bad.collect()] == [("b.pdf", 0)]


def test_names_of_files():
    assert file_export.file_name("a/b:c?.txt") == "a_b_c_.txt" and file_export.file_name(None) == file_export.file_name(" ..") == "unnamed"
    long = file_export.file_name("é" * 300 + ".json")
    assert len(long.encode()) <= 200 and long.endswith(".json")


def test_one_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i % 7}.txt", f"text {i}\nline") for i in range(40)] + [("empty", None)], "name string, content string").repartition(5)
    file_export.write_files(rows, f"{tmp_path}/out")
    back = file_export.read_files_back(spark, f"{tmp_path}/out").collect()
    assert sorted(r["content"] for r in back) == sorted([f"text {i}\nline" for i in range(40)] + [""] * (len(back) - 40))
    assert not [d for d in os.listdir(tmp_path / "out") if d.startswith("_staging")]
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "out")) == 41


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    @F.udf("string")
    def fail(i):
        if i == 37:
            raise ValueError("a row that can't be written")
        return f"{i}"

    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"), fail("id").alias("content"))
    with pytest.raises(Exception, match="can't be written"):
        file_export.write_files(rows, f"{tmp_path}/out")
    assert [f for at, _, files in os.walk(tmp_path / "out") for f in files if "_staging" not in at] == []


def test_exports_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, "a.PDF", None, None), (2, None, "t", ["c"])], "doc_id long, name string, content string, chunks array<string>")
    for kind in export.ENDINGS:
        assert export.document_files(docs, kind, F.lit("now")).count() == 2
    chat = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, "user", "<b>&\nx")], "conv_id long, turn int, role string, text string")
    html = export.chat_html(chat).collect()[0]["html"]
    assert html.index("User") < html.index("Assistant") and "&lt;b&gt;&amp;<br>x" in html


def test_files_are_listed_in_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"_n{i}.txt", "é\r\n") for i in range(40)], "name string, content string").repartition(4)
    file_export.write_files(rows, f"{tmp_path}/out")
    (tmp_path / "out" / "top.txt").write_text("t")
    folders = file_export.FileReader(f"{tmp_path}/out").partitions()
    assert len(folders) == 5  # the driver knows what tasks wrote, not each file
    back = file_export.read_files_back(spark, f"{tmp_path}/out")
    assert back.rdd.getNumPartitions() == 5
    assert sorted((r["name"], r["content"]) for r in back.collect()) == sorted([(f"_n{i}.txt", "é\r\n") for i in range(40)] + [("top.txt", "t")])


def test_pages_are_laid_out_in_their_row(spark):
    rows = spark.createDataFrame(
        [(1, 1, [("low", 0.0, 10.0), (" ", 0.0, 90.0), ("top", 0.0, 700.4), ("right", 50.0, 699.0), (None, 0.0, 0.0)], None), (1, 2, None, "bad"), (1, 3, [], None)],
        f"doc_id long, page int, items {pages.ITEMS}, problem string",
    )
    texts = pages.page_texts(rows)
    assert [(r["page"], r["text"], r["ok"]) for r in texts.orderBy("page").collect()] == [(1, "top right low", True), (2, "", False), (3, "", True)]
    by_layout = pages.page_texts(rows, documents.page_text_lines)
    assert sorted(map(tuple, by_layout.collect()), key=str) == sorted(map(tuple, texts.collect()), key=str)
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()


def test_each_result_reads_the_files_once(spark):
    files = spark.createDataFrame([("a", "n", 1, b"p\nq")], "doc_id string, name string, size long, content binary")
    docs, _ = pages.read_documents(files, lambda b: b.decode().split("\n"), lambda p: [{"str": p, "x": 0, "y": 0}])
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["pages"], r["successful_pages"]) for r in docs.collect()] == [(2, 2)]

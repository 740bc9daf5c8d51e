"""Operators on small tables, empty ones and odd values."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import metrics as M
from lectern.operators import search as S
from lectern.operators.ask import ask, find_relevant_chunks
from lectern.operators.filters import Filters, compile_filter, document_filter
from lectern.sources import documents as D
from lectern.streaming import events as E

CHUNKS = "chunk_id string, doc_id string, chunk_index int, source string, content string, embedding array<double>"


def test_diverse_top_k(spark):
    rows = [("q", d, i, f"{d} (chunk {i + 1})", s) for d, i, s in [("A", 0, 0.9), ("A", 1, 0.8), ("B", 0, 0.3), ("A", 2, 0.7), ("C", 0, 0.5)]]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, chunk_index int, source string, similarity double")
    found = [(r["doc_id"], r["chunk_index"]) for r in S.diverse_top_k(df, 4).orderBy("rank").collect()]
    assert found == [("A", 0), ("C", 0), ("B", 0), ("A", 1)]


def test_token_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, 100), ("q", 2, 1000), ("q", 3, 2)], "query_id string, rank int, tokens int")
    assert [r["rank"] for r in S.token_prefix(df, 500).collect()] == [1]


def test_thresholds():
    assert S.threshold_of("local", "keyword", 0) == 0 and S.threshold_of("local", "semantic", 0) == 0.1
    assert S.threshold_of("pinecone", "hybrid", None) == 0.05 and S.threshold_of("chroma", "semantic", None) is None


def test_search_skips_unfit_vectors(spark):
    chunks = spark.createDataFrame(
        [("a", "1", 0, "x", "cat sat", [1.0, 0.0]), ("b", "1", 1, "x", None, [1.0]), ("c", "2", 0, "y", "dog", None), ("d", "2", 1, "y", "", [0.0, 0.0])], CHUNKS
    )
    queries = spark.createDataFrame([(1, "cat", [1.0, 0.0])], "query_id int, question string, embedding array<double>")
    assert [r["chunk_id"] for r in S.search(queries, chunks, "semantic").collect()] == ["a"]
    assert S.search(queries, chunks.where("false"), "hybrid").count() == 0
    answer = ask(queries, chunks).first()
    assert answer["sources"] == ["x (chunk 1)"] and answer["relevance"] == pytest.approx(1)
    assert ask(queries, chunks.where("false")).first()["retrieved"] == []


def test_bm25(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, ""), (4, None), (5, "d")], "chunk_id long, content string")
    queries = spark.createDataFrame([(7, "A, a c"), (8, "!!"), (9, None)], "query_id long, question string")
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in S.bm25(queries, chunks).collect()}
    idf = lambda df: math.log1p((5 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.2))
    assert set(got) == {(7, 1), (7, 2)}
    assert got[7, 1] == pytest.approx(idf(2) * part(1, 2)) and got[7, 2] == pytest.approx(idf(2) * part(2, 3) + idf(1) * part(1, 3))
    assert not S.bm25(queries, chunks.where("false")).collect()


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "Ann", ["x"], "2024-01-01"), (2, None, None, None), (3, "bob", ["y"], "2025-01-01")], "doc_id int, author string, tags array<string>, date string"
    )
    ids = lambda f: [r["doc_id"] for r in df.where(f).orderBy("doc_id").collect()]
    assert ids(document_filter(Filters())) == [1, 2, 3]
    assert ids(document_filter(Filters(authors=["ANN"]))) == [1]
    assert ids(document_filter(Filters(tags=["y", "z"]))) == [3]
    assert ids(document_filter(Filters(date_from="2024-01-01", date_to="2024-12-31"))) == [1, 2]
    assert ids(compile_filter({"author": {"$in": ["bob"]}, "doc_id": {"$gte": 2}})) == [3]
    with pytest.raises(ValueError):
        compile_filter({"a": {"$near": 1}})


def test_index_keeps_the_last_write(spark, tmp_path):
    index = I.ChunkIndex(spark, f"file://{tmp_path}/index", 2)
    assert not index.exists() and index.count() == 0
    index.create()
    rows = spark.createDataFrame([("a", "1", 0, "x", "old", [1.0, 2.0]), ("b", "2", 0, "y", "", [1.0, 2.0]), ("c", "2", 1, "y", "ok", [1.0])], CHUNKS)
    index.upsert(rows)
    assert [r["chunk_id"] for r in index.scan().collect()] == ["a"]
    index.upsert(rows.where("chunk_id = 'a'").withColumn("content", F.lit("new")))
    assert [r["content"] for r in index.scan().collect()] == ["new"]
    index.append(rows.where("chunk_id = 'a'"))
    assert index.count() == 2
    index.delete(["1"])
    assert index.count() == 0
    index.delete(["1"])
    many = spark.range(40).selectExpr("cast(id as string) chunk_id", "cast(id % 4 as string) doc_id", "'x' content", "array(1D, 2D) embedding")
    index.append(many)
    index.upsert(many.where("chunk_id < '2'").withColumn("content", F.lit("new")))
    index.delete(["3"])
    kept = {r["chunk_id"]: r["content"] for r in index.scan().collect()}
    assert kept == {str(n): "new" if str(n) < "2" else "x" for n in range(40) if n % 4 != 3}
    assert [x.name for x in tmp_path.iterdir()] == ["index"]
    index.clear()
    assert index.exists() and index.count() == 0


def test_page_lines_go_from_top_to_bottom(spark):
    items = [("d", 1, 0, "low", 0.0, 10.0), ("d", 1, 1, "top", 0.0, 90.0), ("d", 1, 2, "right", 50.0, 90.2), ("d", 1, 3, "  ", 0.0, 5.0), ("e", 1, 0, None, None, None)]
    df = spark.createDataFrame(items, "doc_id string, page int, pos int, str string, x double, y double")
    assert {r["doc_id"]: r["text"] for r in D.page_text_lines(df).collect()} == {"d": "top right low", "e": ""}


def test_reject_reasons(spark):
    df = spark.createDataFrame([("application/pdf", 100 * D.MEGABYTE), ("application/pdf", 0), ("text/plain", 5), ("application/pdf", 100 * D.MEGABYTE + 1)], "m string, n long")
    assert [r["x"] for r in df.select(D.reject_reason("m", "n").alias("x")).collect()] == [None, "empty file", "not a PDF", "file too large"]


def test_extract_reports_a_file_that_fails(spark):
    files = spark.createDataFrame([("a", b"one two"), ("b", b"bad")], "path string, content binary")

    def reader(content):
        if content == b"bad":
            raise ValueError("damaged")
        return [[{"str": w, "x": 0, "y": 0} for w in content.decode().split()], []]

    rows = D.extract_with(files, reader).orderBy("path", "page", "pos").collect()
    assert [(r["path"], r["page"], r["str"], r["ok"]) for r in rows] == [("a", 1, "one", True), ("a", 1, "two", True), ("a", 2, None, True), ("b", 0, None, False)]


def test_embedding_replies(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[[3], [4]]",), ('{"embedding": [5]}',), ("[]",), ("oops",)], "p string")
    assert [r["x"] for r in df.select(D.normalize_embedding("p").alias("x")).collect()] == [[1.0, 2.0], [3.0], [5.0], None, None]


def test_events(spark):
    df = spark.createDataFrame([('data: {"stage":"search","status":"done"}\n\ndata: [DONE]\n\n',)], "t string")
    assert [(e["stage"], e["status"]) for e in df.select(E.parse_events("t").alias("x")).first()["x"]] == [("search", "done")]


def test_running_metrics_of_an_empty_table(spark):
    df = spark.createDataFrame([], "session_id int, response_time double, relevance double, ts timestamp")
    assert M.running_metrics(df).count() == 0 and M.session_metrics(df).count() == 0


def test_all_relevant_chunks(spark):
    chunks = spark.range(10_050).select(F.col("id").alias("chunk_id"), F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.lit("s").alias("source"), F.array(F.lit(1.0), F.col("id") / 1e4).alias("embedding"), F.lit("x").alias("content"))
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, question string, embedding array<double>")
    found = find_relevant_chunks(queries, chunks, None, Filters(min_similarity=-1.0))
    assert found.count() == 10_050 and "Window" not in found._jdf.queryExecution().executedPlan().toString()

"""Indexes against scoring everything, and what they leave unread."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import keyword_score
from lectern.operators.index import ChunkIndex, validate
from lectern.operators.keyword_index import KeywordIndex
from lectern.operators.vector_index import APART, VectorIndex
from lectern.plans import tables

VECTORS = "chunk_id long, embedding array<double>"


def cosines(rows, q):
    out = []
    for i, v in rows:
        if v is None or any(x is None or np.isnan(x) for x in v):
            continue
        a, b = np.array(v), np.array(q)
        size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) if len(a) == len(b) else 0
        out.append((float(a @ b / size) if size else 0.0, i))
    return out


@pytest.mark.parametrize("spread, threshold", [(0.05, -1.0), (0.05, 0.5), (3.0, -1.0)])
def test_nearest_chunks_by_cells(spark, tmp_path, spread, threshold):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((25, 16))
    rows = [(i, (centers[i % 25] + spread * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000, [0.0] * 16), (2001, [1.0, 2.0]), (2002, None), (2003, rows[0][1]), (2004, [float("nan")] + [1.0] * 15)]
    asked = [(1, rows[3][1]), (2, (centers[7] + 0.1).tolist()), (3, [0.0] * 16), (4, [1.0, 2.0]), (5, None)]
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.build(spark.createDataFrame(rows, VECTORS).repartition(3), cells=40)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    found = index.search(queries, 7, threshold).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score")).collect()
    want = set()
    for q, v in asked:
        if v is not None:
            best = sorted((round(-s, 9), i) for s, i in cosines(rows, v) if s >= threshold)[:7]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["chunk_id"], r["score"] + 0.0) for r in found} == {(q, k, i, s + 0.0) for q, k, i, s in want}
    near = VectorIndex(spark, f"{tmp_path}/v")
    near.search(queries.where("query_id = 1"), 7, threshold).collect()
    assert APART in near.cells_read
    if spread < 1:
        assert len(near.cells_read) < 10  # of 40 and the one apart
    index.build(spark.createDataFrame([], VECTORS))
    assert index.search(queries, 7).collect() == []


def test_keyword_candidates_are_all_that_score(spark, tmp_path):
    texts = ["the quick brown fox", "foxes run", "a quickly drawn box", "", None, "Quick! quick? QUICK", "un-der-stand", "é été", "ox", "q"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "quick fox"), (2, "understand x"), (3, "!!!"), (4, "q"), (5, "étés"), (6, None), (7, "nothing-like-it zzz")], "query_id long, question string")
    index = KeywordIndex(spark, f"{tmp_path}/k", buckets=8)
    index.build(docs)
    scored = docs.crossJoin(asked).withColumn("score", keyword_score("question", "content", empty_is_zero=True)).where("score > 0")
    want = {(r["query_id"], r["chunk_id"]) for r in scored.collect()}
    assert {(r["query_id"], r["chunk_id"]) for r in index.candidates(asked).collect()} == want
    found = index.search(asked, docs, 100, "pinecone", 0.0001)
    exact = {(r["query_id"], r["chunk_id"], r["score"]) for r in scored.collect()}
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in found.collect()} == exact


def test_an_index_keeps_what_it_was_made_for(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/i", dimension=2, buckets=32, metric="cosine")
    index.create()
    rows = spark.range(300).selectExpr("cast(id as string) chunk_id", "cast(id % 9 as string) doc_id", "cast(id as int) chunk_index", "'x' content", "array(1D, 2D) embedding")
    index.upsert(rows)
    again = ChunkIndex(spark, f"{tmp_path}/i")
    assert (again.dimension, again.buckets, again.metric) == (2, 32, "cosine") and again.check().collect()[0]["fitting"] == 300
    with pytest.raises(ValueError, match="not 3"):
        ChunkIndex(spark, f"{tmp_path}/i", dimension=3)
    found = again.scan({"chunk_id": {"$in": ["7", "12"]}, "doc_id": "7"})
    assert [r["chunk_id"] for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "EqualTo(doc_id,7)" in plan
    assert len(found.inputFiles()) and again.scan({"chunk_id": {"$in": []}}).count() == 0
    read = found.select(F.input_file_name().alias("f")).distinct().count()
    assert read == 1


def test_long_texts_stay_whole(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/i")
    index.create()
    rows = spark.createDataFrame([("a", "1", "y" * 90_000, [1.0])], "chunk_id string, doc_id string, content string, embedding array<double>")
    index.upsert(rows)
    assert len(index.scan().collect()[0]["content"]) == 90_000


def test_what_a_stopped_writer_left_goes(spark, tmp_path):
    index = ChunkIndex(spark, f"{tmp_path}/i")
    for name in ("i-staged-" + "0" * 32, "i-new-" + "a" * 32, "i-other", "ii-new-" + "a" * 32):
        (tmp_path / name).mkdir()
    index.create()
    assert sorted(x.name for x in tmp_path.iterdir()) == ["i", "i-other", "ii-new-" + "a" * 32]


def test_only_finite_vectors_are_sound(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, -2.0], [0.0], [None, 1.0], [None, inf], [None], [nan, 1.0], [1.0, inf], [-inf, nan], [-inf], [], None]
    rows = spark.createDataFrame([(str(i), "text", v) for i, v in enumerate(vectors)], "chunk_id string, content string, embedding array<double>")
    found = {int(r["chunk_id"]): r["problem"] for r in validate(rows).collect()}
    assert found == {0: None, 1: None, **dict.fromkeys(range(2, 9), "embedding is not finite"), 9: "empty embedding", 10: "empty embedding"}
    index = ChunkIndex(spark, f"{tmp_path}/i", buckets=2)
    index.create()
    index.upsert(rows.withColumn("doc_id", F.lit("a")))
    assert index.count() == 2
    # a document without sound rows stays, unless it is named; then no bucket is left behind
    named = rows.withColumn("doc_id", F.lit("a"))
    index.replace_documents(named.where("chunk_id > 1"), stored=True)
    assert index.count() == 2
    index.replace_documents(named.where("chunk_id > 1"), named.select("doc_id"), stored=True)
    assert index.count() == 0 and not list((tmp_path / "i").glob("bucket=*"))


def test_places_by_spans_of_scores(spark):
    from lectern.operators.search import rank_in_parts

    rng = np.random.default_rng(4)
    rows = [(q, i, float(rng.integers(-40, 40)) / 16) for q in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double")
    for step in (0.001, 0.5, 100.0):
        found = {(r["query_id"], r["chunk_id"]): r["place"] for r in rank_in_parts(df, "score", "place", step).collect()}
        for q in range(3):
            order = sorted((-s, i) for a, i, s in rows if a == q)
            assert [found[q, i] for _, i in order] == list(range(1, 201))


def test_texts_made_after_dealing_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), str(i % 3), f"t{i} ") for i in range(50)], "chunk_id string, doc_id string, text string")
    plain, dealt = ChunkIndex(spark, f"{tmp_path}/a"), ChunkIndex(spark, f"{tmp_path}/b")
    plain.create(), dealt.create()
    long = lambda r: r.withColumn("content", F.repeat("text", F.lit(25)))
    plain.append(long(rows))
    dealt.append(long(dealt.dealt(rows)), dealt=True)
    held = lambda index: sorted((r["chunk_id"], r["content"]) for r in index.scan().collect())
    assert held(plain) == held(dealt) and len(held(dealt)) == 50
    assert [r["chunk_id"] for r in dealt.scan({"chunk_id": {"$in": ["7"]}}).collect()] == ["7"]


def test_a_text_has_one_form_for_all_its_questions(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "Red fox, red"), (2, "blue bird"), (3, None), (4, "")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "red bird"), (2, "fox"), (3, "zzz")], "query_id long, question string")
    index = KeywordIndex(spark, f"{tmp_path}/k")
    index.build(chunks)
    found = index.search(asked, chunks, 5)
    pairs = chunks.where("content <> ''").crossJoin(asked).withColumn("score", keyword_score("question", "content")).where("score > 0")
    key = lambda r: (r["query_id"], r["chunk_id"], round(r["score"], 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, pairs.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("lower(content")


def test_texts_beyond_the_vectors_stay_where_they_are(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in (("some", 10), ("none", 0)):
        e = spark.range(3, 3 + n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))
        e.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        os.symlink(f"{tmp_path}/documents.parquet", f"{tmp_path}/{name}/documents.parquet")
        found = tables.chunks(spark, f"{tmp_path}/{name}")
        assert found.count() == n
        assert not n or "<= 12)" in found._jdf.queryExecution().optimizedPlan().toString()

"""Search by words over texts that are held apart from the vectors' table."""

from pyspark.sql import functions as F

from lectern.operators import search as S

CHUNKS = [(i, f"d{i % 3}", i, [float(i % 5), 1.0, 0.5 * (i % 2)]) for i in range(12)] + [(90, "d0", 0, [1.0, 1.0, 1.0])]
TEXTS = [(i, "red fox " * (i % 4) + f"blue {i}") for i in range(11)] + [(11, None), (70, "red red fox of no chunk")]
QUERIES = [(1, "red fox", [1.0, 1.0, 0.0]), (2, "blue", [0.0, 1.0, 1.0])]


def _tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, doc_id string, chunk_index int, embedding array<double>")
    texts = spark.createDataFrame(TEXTS, "chunk_id long, content string")
    return spark.createDataFrame(QUERIES, "query_id long, question string, embedding array<double>"), chunks, texts


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_texts_apart_give_the_same_hits(spark):
    queries, chunks, texts = _tables(spark)
    together = chunks.join(texts, "chunk_id")
    for mode in ("keyword", "hybrid", "semantic"):
        for ties in (("chunk_id",), ("doc_id", "chunk_index")):
            a, b = (S.search(queries, c, mode, "weaviate", threshold=0.2, ties=ties, texts=t) for c, t in ((together, None), (chunks, texts)))
            a, b = (sorted(tuple(r) for r in x.select("query_id", "rank", "chunk_id", "content", F.round("score", 9)).collect()) for x in (a, b))
            assert a and a == b


def test_a_repeated_chunk_counts_alike(spark):
    queries, chunks, texts = _tables(spark)
    texts = texts.union(texts.where("chunk_id = 2"))
    a, b = S.bm25(queries, chunks.join(texts, "chunk_id")), S.bm25(queries, chunks, texts=texts)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_no_text_is_shuffled(spark, tmp_path):
    from lectern.plans.search import QUERIES as PLANS

    spark.range(6).selectExpr("id as vec_id", "cast(id % 2 as int) as label", "array(1.0D, cast(id as double)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(9).repartition(8).selectExpr("id as doc_id", "concat('the ation ', id) as text").write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("weaviate_keyword", "weaviate_hybrid"):
            plan = PLANS[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().initialPlan()
            dealt = [x for x in _nodes(plan) if x.nodeName() == "Exchange" and "hashpartitioning" in x.outputPartitioning().toString()]
            assert dealt and not any("content" in x.output().mkString(" ") for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

"""Models that fail, and functions for SQL on odd texts."""

import numpy as np
from pyspark.sql import functions as F

from lectern.functions.embedding import fallback_vector
from lectern.functions.sql import register
from lectern.operators import chunking
from lectern.operators import models as M


def test_a_batch_that_fails_is_tried_again_and_then_one_by_one():
    asked = []

    def call(texts):
        asked.append(list(texts))
        if len(asked) == 1:
            raise ConnectionError("busy")
        if "bad" in texts:
            raise ValueError("can't read")
        return [t.upper() for t in texts]

    caller = M.Caller(call, M.Calls(batch=2, tries=2))
    assert caller.run(["a", None, "b", "c", "bad", "d"]) == [
        ("A", None, 2), (None, None, 0), ("B", None, 2), ("C", None, 3), (None, "ValueError: can't read", 4), ("D", None, 1),
    ]
    assert asked == [["a", "b"], ["a", "b"], ["c", "bad"], ["c", "bad"], ["c"], ["bad"], ["bad"], ["d"]]


def test_calls_have_a_budget_and_values_are_checked():
    caller = M.Caller(lambda texts: texts, M.Calls(batch=1, most=2), lambda v: v != "x")
    assert caller.run(["a", "x", "b"]) == [("a", None, 1), (None, "unusable value", 1), (None, M.SPENT, 0)]
    assert M.Caller(lambda texts: texts[1:], M.Calls(tries=1, alone=False)).run(["a", "b"])[0][1] == "ValueError: 1 values for 2 texts"
    assert M.Caller(lambda texts: texts, M.Calls()).run([]) == []
    assert not any(map(M.finite_vector, ([], None, [float("nan")], [None], "", 3, ["x"]))) and M.finite_vector([1, 2.5])


def test_vectors_of_a_model_that_is_gone(spark):
    def gone(texts):
        raise OSError("no route")

    rows = spark.createDataFrame([(1, "text"), (2, None), (3, " ")], "id long, text string").withColumns({c: F.lit(1) for c in ("size", "vector")})
    for call, error in ((gone, "OSError: no route"), (None, None)):
        found = {r["id"]: r for r in M.embed_with_model(rows, "text", call, how=M.Calls(tries=1)).collect()}
        assert {i: r["made_by"] for i, r in found.items()} == {1: "local", 2: "invalid", 3: "invalid"} and found[1]["error"] == error
        assert np.allclose(found[1]["embedding"], fallback_vector("text")) and np.allclose(found[2]["embedding"], fallback_vector("invalid input"))
    probe = M.probe_model(spark, gone).collect()[0]
    assert not probe["ok"] and probe["error"] == "OSError: no route" and M.probe_model(spark, lambda t: t).collect()[0]["ok"]
    assert M.call_model(rows.where("false"), "text", gone).count() == 0


def test_models_that_take_blanks_are_asked_for_them(spark):
    lengths = lambda texts: [[float(len(t))] if len(t) % 2 == 0 else [] for t in texts]
    rows = spark.createDataFrame([(1, ""), (2, " "), (3, " \n"), (4, "ab"), (5, None)], "id long, text string")
    found = {r["id"]: (r["made_by"], sum(r["embedding"])) for r in M.embed_with_model(rows, "text", lengths, "plain", most_chars=300, blanks=True).collect()}
    assert found == {1: ("model", 0.0), 2: ("local", 0.25), 3: ("model", 2.0), 4: ("model", 2.0), 5: ("invalid", sum(map(ord, M.INVALID)) / 128)}
    assert {r["made_by"] for r in M.embed_with_model(rows.where("id < 4"), "text", lengths, "plain").collect()} == {"invalid"}


def test_chunkers_in_sql_equal_the_columns(spark):
    register(spark)
    register(spark)
    texts = [None, "", "  ", "one", "a b " * 500, "x" * 900 + " y", "p one.\n\np two! Three?\n \n" * 40, "é ü 😀 " * 300, "tab\tand\nline"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    docs.createOrReplaceTempView("sql_docs")
    for sql, column in (
        ("pack_chunks(d.text, 120)", chunking.pack_words("text", 120)), ("window_chunks(d.text, 100, 30)", chunking.chunk_windows("text", 100, 30)),
        ("paragraph_chunks(d.text, 200, 60)", chunking.chunk_paragraphs("text", 200, 60)), ("text_paragraphs(d.text)", chunking.paragraphs("text")),
    ):
        name = "paragraph_index" if sql.startswith("text_") else "chunk_index"
        got = sorted(map(tuple, spark.sql(f"SELECT d.i, c.{name}, c.content FROM sql_docs d, LATERAL {sql} c").collect()))
        assert got == sorted(map(tuple, docs.select("i", F.posexplode(column)).collect())), sql


def test_packed_chunks_equal_a_greedy_walk(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 30, rng.integers(0, 60))) for _ in range(60)] + ["y" * 50 + " " + "z" * 50]

    def greedy(text, size):
        out = []
        for w in text.split():
            if out and len(out[-1]) + len(w) + 1 <= size:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for size in (1, 20, 45):
        for r in docs.select("text", chunking.pack_words("text", size).alias("c")).collect():
            assert r["c"] == greedy(r["text"], size)

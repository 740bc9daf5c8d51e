"""Hand-checked cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import embedding as V
from lectern.functions import text as T
from lectern.functions.similarity import cosine, cosine_strict
from lectern.operators import chunking as C


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query, content, score, empty",
    [
        ("data privacy", "Data privacy matters.", 1.0, False),
        ("data privacy", "metadata only", 0.25, False),
        ("data privacy law", "the data and a privacy notice", 2 / 3 + 1 / 6, False),
        ("cat", "concatenate", 0.5, False),
        ("cat", "a cat sat", 1.0, False),
        ("!!!", "text", 0.0, False),
        ("data", "", 0.5, False),
        ("data", "", 0.0, True),
        ("data", "!!!", 0.5, True),
        ("the the", "the end", 1.0, False),
    ],
)
def test_keyword_score(spark, query, content, score, empty):
    assert one(spark, T.keyword_score(F.col("q"), F.col("c"), empty), q=query, c=content) == pytest.approx(score)


@pytest.mark.parametrize("text, value", [("", 0), ("a", 97), ("test", 3556498), ("hello world", 1794106052), ("The quick brown fox", 1739336029)])
def test_simple_hash(spark, text, value):
    assert one(spark, V.simple_hash(F.col("t")), t=text) == value == V._hash(text)


def test_embeddings_have_unit_length(spark):
    for name, embed in V.EMBEDDERS.items():
        v = one(spark, embed(F.col("t")), t="Some words here")
        if name != "plain":
            assert math.sqrt(sum(x * x for x in v)) == pytest.approx(1)
    assert one(spark, V.fallback_embedding(F.col("t")), t="  ") == V.fallback_vector("default text").tolist()


def test_cosine(spark):
    assert one(spark, cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, cosine("a", "b"), a=[1.0], b=[1.0, 1.0]) == 0
    with pytest.raises(Exception, match="dimensions"):
        one(spark, cosine_strict("a", "b"), a=[1.0], b=[1.0, 1.0])


def test_paragraph_chunks_carry_sentences_over(spark):
    text = "Intro one. Intro two.\n\nSecond para here.\n\nThird."
    expected = ["Intro one. Intro two.", "Intro two.Second para here.", "Second para here.Third."]
    assert one(spark, C.chunk_paragraphs(F.col("t"), 30, 12), t=text) == expected
    assert one(spark, C.sentence_overlap(F.col("t"), 10), t="Alpha beta. Gamma delta! Eps?") == "Gamma delta. Eps."


def test_packing_keeps_words(spark):
    text = "one two  three\nfour " + "x" * 30
    found = one(spark, C.pack_words(F.col("t"), 10), t=text)
    assert " ".join(found).split() == text.split()
    assert found[-1] == "x" * 30 and all(len(c) <= 10 for c in found[:-1])
    assert one(spark, C.pack_words(F.col("t"), 10), t="  ") == []


def test_fixed_windows_end(spark):
    assert one(spark, C.chunk_windows(F.col("t"), 4, 1), t="abcdefghij") == ["abcd", "defg", "ghij"]
    assert one(spark, C.chunk_windows(F.col("t"), 4, 1), t="") == []
    with pytest.raises(ValueError):
        C.chunk_windows(F.lit("x"), 3, 3)


@pytest.mark.parametrize("question, kind", [("show me", "analysis"), ("sometimes", "timeline"), ("List all", "summary"), ("x versus y", "comparison"), ("hm", "general")])
def test_question_type(spark, question, kind):
    assert one(spark, T.question_type(F.col("q")), q=question) == kind


@pytest.mark.parametrize("question, level", [("What is it?", "simple"), ("what? and? so", "complex"), ("tell me", "normal"), ("when " + "x" * 160, "complex")])
def test_complexity(spark, question, level):
    assert one(spark, T.complexity(F.col("q")), q=question) == level


@pytest.mark.parametrize("level, prefix", [("simple", 1680), ("normal", 1120), ("complex", 840)])
def test_token_allocation(spark, level, prefix):
    assert one(spark, T.token_allocation(F.lit(4000), F.col("l"))["prefix"], l=level) == pytest.approx(prefix)


def test_clean_response(spark):
    noisy = "**Confidence: HIGH** Fine.\n\n\n\nNote: drop this\nkept"
    assert one(spark, T.clean_response(F.col("t")), t=noisy) == "Fine.\n\n\nkept"


def test_thinking_parts(spark):
    parts = one(spark, T.thinking_parts(F.col("t")), t="a <think>b\nc</think> d")
    assert [(p["type"], p["content"]) for p in parts] == [("text", "a"), ("thinking", "b\nc"), ("text", "d")]
    assert [p["type"] for p in one(spark, T.thinking_parts(F.col("t")), t="")] == ["text"]


@pytest.mark.parametrize("n, said", [(0, "0 Bytes"), (512, "512 Bytes"), (1536, "1.5 KB"), (1048576, "1 MB")])
def test_file_size(spark, n, said):
    assert one(spark, T.file_size(F.col("n")), n=n) == said

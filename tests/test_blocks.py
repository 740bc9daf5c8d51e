"""Embedders over blocks of texts, texts cut once, and what each keeps in memory."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import embedding as V
from lectern.operators import chunking as C
from lectern.operators import ingest as N

TEXTS = [None, "", "  ", "a", "Été 中文 😀　İz a", "word " * 40, "x" * 3000, " lead and\ttail\n"]


def _defined(text, taps, dimension):
    out = np.zeros(dimension)
    for c in text or "":
        for factor, weight in taps:
            out[ord(c) * factor % dimension] += weight * ord(c)
    return out


def test_blocks_equal_the_definition():
    plain, hashed = V._plain(TEXTS, 384), V._hashed(TEXTS, 384)
    for i, t in enumerate(TEXTS):
        assert np.allclose(plain[i], _defined(t, ((1, 1 / 128),), 384))
        whole = _defined(t, V._THREE, 384)
        for word in (t or "").lower().split():
            h = 0
            for c in word:
                h = (31 * h + ord(c) + 2**31) % 2**32 - 2**31
            whole[abs(h) % 384] += 0.3 * len(word)
        assert np.allclose(hashed[i], whole / (np.linalg.norm(whole) or 1))
        assert (hashed[i] == V.hashed_vector(t)).all()


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(V, "BLOCK_CHARS", 10)
    texts = pa.array(["abc", "def", None, "g" * 30, "hi"] * 200)
    found = list(V._blocks(texts))
    assert [t for _, block in found for t in block] == texts.to_pylist()
    assert all(sum(len(t or "") for t in block) <= 10 or len(block) == 1 for _, block in found)
    monkeypatch.setattr(V, "BLOCK_COUNTS", 4)
    assert np.array_equal(V._tapped(["ab", "cd", "ea"], 8), np.stack([V._tapped([t], 8)[0] for t in ("ab", "cd", "ea")]))


@pytest.mark.parametrize("embedder", sorted(V.BLOCKWISE))
def test_vectors_by_block_equal_those_of_the_column(spark, embedder):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    column = {r["id"]: r["v"] for r in rows.select("id", V.EMBEDDERS[embedder]("t").alias("v")).collect()}
    assert {r["id"]: r["v"] for r in V.with_vectors(rows, "t", embedder, "v").collect()} == column


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, " \n"), (3, None)], "doc_id long, text string")
    rows = N.ingest(docs, "plain")[0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(".{0,399}") == 1
    assert [(r["doc_id"], r["chunk_index"], r["content"]) for r in rows.collect()] == [(1, 0, "one two")]
    assert [(r["doc_id"], r["problem"]) for r in N.ingest(docs, "plain")[1].orderBy("doc_id").collect()] == [(2, "no text"), (3, "no text")]


def test_chunk_rows_cut_a_text_once(spark):
    docs = spark.createDataFrame([(1, "\n\nfirst one.\n\nsecond"), (2, ""), (3, None)], "doc_id long, text string")
    rows = C.chunk_rows(docs, C.chunk_paragraphs("text", 5, 4))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(filter(transform(split(text") == 1
    found = [(r["doc_id"], r["chunk_index"], r["start_char_ref"]) for r in rows.orderBy("chunk_index").collect()]
    assert found == [(1, 0, 2), (1, 1, 2)] and "_begin" not in rows.columns

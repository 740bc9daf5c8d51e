"""What is done for each character of a text: white space at its ends and within it, without patterns where none is needed."""

from pyspark.sql import functions as F

from lectern.functions.text import BLANKS, single_blanks, trim
from lectern.operators import chunking as C
from lectern.operators import ingest as N


def test_trim_takes_blanks_of_both_ends_only(spark):
    texts = [f"{b}a{b}{c}b{c}" for b in BLANKS for c in BLANKS] + ["", BLANKS, " a ", "a \u0085", "a  ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trim("t").alias("x"), single_blanks("t").alias("y"))
    for r in rows.collect():
        t = r["t"]
        assert r["x"] == (t if t is None else t.strip(BLANKS))
        single = t if t is None else "".join(" " if c in BLANKS else c for c in t)
        while single and "  " in single:
            single = single.replace("  ", " ")
        assert r["y"] == (t if t is None else single.strip(" "))


def test_chunks_ask_no_pattern_for_ends(spark):
    docs = spark.createDataFrame([(1, " one  two\n\nthree ")], "doc_id long, text string")
    for rows in (N.ingest(docs, "plain")[0], C.chunk_rows(docs, C.chunk_paragraphs("text", 50, 10))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert r"\s+$" not in plan and "regexp_replace(regexp_replace" not in plan
    assert N.ingest(docs, "plain")[0].first()["content"] == "one two three"


def test_ingested_texts_stand_beside_their_vectors_batch_by_batch(spark):
    docs = spark.createDataFrame([(i, f"text {i}", [str(i)]) for i in range(700)] + [(700, " \n", None)], "doc_id long, text string, tags array<string>")
    rows = N.ingested(docs, "plain", keep=("tags",))
    assert rows.columns == ["doc_id", "chunk_id", "chunk_index", "content", "embedding", "embedder", "tags"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    found = rows.select("doc_id", "content", "tags", F.size("embedding").alias("n")).collect()
    assert sorted((r["doc_id"], r["content"], r["tags"], r["n"]) for r in found) == [(i, f"text {i}", [str(i)], 384) for i in range(700)]


def test_only_the_paragraph_asked_for_is_trimmed(spark):
    texts = ["one\n\n two. three \n \n", "\n\n a \n\n\n b", "x", " \n\n ", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    found = docs.select(C.end_paragraph("t").alias("a"), C.end_paragraph("t", last=True).alias("b")).collect()
    assert [tuple(r) for r in found] == [("one", "two. three"), ("a", "b"), ("x", "x"), (None, None), (None, None), (None, None)]
    rows = C.chunk_rows(docs.withColumnRenamed("t", "text"), F.array(F.lit("two. three"), F.lit("not there"), F.lit(" ")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "filter(transform(split(" not in plan
    got = {(r["text"], r["content"]): r["start_char"] for r in rows.collect()}
    assert got[texts[0], "two. three"] == 6 and got[texts[0], "not there"] == -1 and got["x", " "] is None


def test_overlap_of_blank_and_long_sentences(spark):
    rows = spark.createDataFrame([("a b. . c d! ?e f",), ("....",), ("",), ("one",)], "t string")
    found = [r[0] for r in rows.select(C.sentence_overlap(F.col("t"), 6)).collect()]
    assert found == ["c d. e f.", "", "", "one."]

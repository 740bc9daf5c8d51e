"""Whole queries against brute force where no SQL can say it, and odd tables: nulls, empty ones, clashing names, huge numbers."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import language, mixing, neighbours, packing, secrets, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def said(i, n, letters="abcdefgh"):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))


# -- mixing ----------------------------------------------------------------------------------------


def seats_of(votes: dict, seats: int) -> dict:
    """Sainte-Laguë seat by seat; ties to the smaller party."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min((p for p in votes if votes[p] > 0), key=lambda p: (-votes[p] / (2 * won[p] + 1), p is None, p if p is not None else ""))
        won[best] += 1
    return won


@pytest.mark.parametrize("shard_words", [200, 100_000])
def test_what_each_document_is_taken_equals_brute_force(spark, shard_words):
    texts = [(i, said(i, 3 + (i * 7) % 90), ["b", "a", None, "c"][i % 4]) for i in range(90)] + [(None, said(5, 40), "a")] * 4 + [(200, None, "c"), (201, "", "b"), (3, said(999, 20), "c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, shard_words=shard_words)
    found = sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], r["taken"]) for r in plan.collect()), key=str)
    rows = [tuple(r) for r in mixing.numbered_sizes(docs, mixing.SEED).withColumn("bin", F.xxhash64("order")).collect()]  # doc_id, source, size, order, bin
    size = defaultdict(int)
    for _, source, n, _, _ in rows:
        size[source] += n
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, open_to, left = {}, set(size), mixing.SHARE * sum(size.values())
    while True:  # fill sources up to twice their size, share the rest out again
        level = left / sum(weights[s] for s in open_to) if open_to else 0
        full = {s for s in open_to if level * weights[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_to}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2.0 * size[s] for s in full)
        open_to -= full
    blocks = round(sum(target.values()) / mixing.BLOCK_WORDS)
    of_source = seats_of({s: t for s, t in target.items()}, blocks)
    want = []
    for source, n in size.items():
        count = math.ceil((n + 1) / shard_words)
        shards = defaultdict(list)
        for doc_id, s, words, order, at in rows:
            if s == source:
                shards[at % count].append((order, doc_id, words))
        quota = seats_of({k: sum(w for *_, w in v) for k, v in shards.items()}, of_source[source])
        for k, stream in shards.items():
            words = sum(w for *_, w in stream)
            whole = math.ceil(words / mixing.BLOCK_WORDS)
            rounds = min(quota[k], 2 * whole) // whole if whole else 0
            rest, end = (min(quota[k], 2 * whole) - rounds * whole) * mixing.BLOCK_WORDS, 0
            for _, doc_id, w in sorted(stream, key=lambda r: r[0]):
                want.append((doc_id, source, w, n, rounds * w + max(0, min(end + w, rest) - end)))
                end += w
    assert found == sorted(want, key=str)


# -- language --------------------------------------------------------------------------------------


def plain_features(text):
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not letters:
        return None
    data, total = f" {letters} ".encode(), np.zeros(language.DIMENSIONS)
    for n in language.NGRAMS:
        for i in range(len(data) - n + 1):
            h = n
            for byte in data[i : i + n]:
                h = ((h ^ byte) * 0x01000193) % 2**32
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
            total[(h ^ (h >> 13)) % language.DIMENSIONS] += 1 / (len(data) - n + 1)
    row = np.sqrt(total)
    return row / np.sqrt(row @ row)


def test_predictions_equal_machines_asked_one_by_one(spark, tmp_path):
    letters = {"en": "theandof", "de": "schungei", "fr": "éauxtion", "es": "ciónadol"}
    rows = [(i, said(i, 5 + i % 20, letters[lang]), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr", "es"] * 30)]
    rows += [(500, None, "en", "s", 0), (501, "12 !!", None, "s", 0), (502, "ЖДИ меня", None, "s", 0), (503, said(1, 9, letters["de"]) + " 𝔞", None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.train(docs)
    chance = lambda m: 1 / (1 + math.exp(-4 * max(-50, min(50, m))))
    ask = lambda w, x: chance(float(np.float32(x) @ w[:-1] + w[-1]))
    for r in language.op7_language(spark, str(tmp_path)).collect():
        _, text, lang, *_ = rows[r["doc_id"] if r["doc_id"] < 500 else 120 + r["doc_id"] - 500]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        x = plain_features(text)
        if x is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        family = [ask(w, x.astype(np.float32)) for w in model["first"]]
        name = model["families"][int(np.argmax(family))]
        members = model["groups"][name]
        votes = dict.fromkeys(members, 0.0)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                p = ask(model["pairs"][a, b], x.astype(np.float32))
                votes[a] += (p >= 0.5) + p / (2 * len(members))
                votes[b] += (p < 0.5) + (1 - p) / (2 * len(members))
        assert r["lang_pred"] == max(members, key=votes.get) and 0 <= r["score"] <= 1
        if lang and r["doc_id"] < 500:
            assert r["lang_pred"] == lang


# -- odd tables ------------------------------------------------------------------------------------


def test_archives_of_odd_pages(spark, tmp_path):
    html = "<p>" + "x" * 200
    rows = [(1, None, html), (None, "http://h/n", html), (7, "http://h/7", html), (7, "http://h/7", "short"), (3, "http://h/\r\nX: y", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "again", "payload", "archive", "n")})
    (tmp_path / "a").mkdir()
    pages.write.parquet(f"{tmp_path}/a/pages.parquet")
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.op10_warc(spark, f"{tmp_path}/a").collect()), key=str)
    assert found == sorted([(1, "response", None, 203), (None, "revisit", 1, 203), (7, "revisit", 1, 203), (7, "response", None, 5), (3, "response", None, 0), (None, "response", None, 0)], key=str)
    (tmp_path / "b").mkdir()
    pages.where("false").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert warc.op10_warc(spark, f"{tmp_path}/b").count() == 0


def test_neighbours_of_huge_components_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(120)]
    rows += [(140, [1e160] * 8), (160, [-1e160] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("unit", "kind", "cells", "copies", "c1", "vector", "rank", "score")})
    found = defaultdict(list)
    with np.errstate(all="ignore"):
        for r in neighbours.nearest_neighbours(df, k=5).collect():
            found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, _ in rows if i % 20 == 0} and all(len(v) == 5 for v in found.values())
    assert [i for _, i, _ in sorted(found[140])][:1] != [160]


def test_empty_tables_of_all_that_read_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert secrets.scan_secrets(none).count() == 0 and packing.pack(none, packing.default_tokenizer()).count() == 0
    assert language.predict(none, language.train(none), ["doc_id"]).count() == 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), "t")
    assert docs.count() == 0


# -- pipeline --------------------------------------------------------------------------------------


def filtered(rows):
    """Documents and texts after the first three stages, by plain loops. ``rows``: doc_id, text, source."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    bare = lambda line: line.strip(" \t\n\x0b\f\r")
    pages, spread = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        pages[source].add(text)
    for source, texts in pages.items():
        for text in texts:
            for line in set(map(bare, text.split("\n"))) - {""}:
                spread[source, line].add(text)
    from lectern.llm import line_dedup

    gone = {k for k, v in spread.items() if len(v) >= line_dedup.MIN_PAGES and len(v) > line_dedup.RATIO * len(pages[k[0]])}
    rows = [(i, "\n".join(x for x in text.split("\n") if (source, bare(x)) not in gone), source) for i, text, source in rows]
    sets = []
    for _, text, _ in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda x: x[0])
    return sorted((i, text) for i, text, _ in best.values())


def test_documents_that_the_pipeline_keeps_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    boiler = "All rights reserved here."
    copies = [said(77, 60) + "\n" + said(78, 40), said(77, 60) + "\n" + said(78, 39), "12 34"]
    added = [(10_000 + i, f"{boiler}\n{said(300 + i, 30)}\n \n{boiler}", "en", "made", 1) for i in range(30)]
    added += [(20_000 + i, t, "en", "made", 1) for i, t in enumerate(copies * 3)] + [(30_000, None, None, None, None), (30_001, "", "en", "made", 0)]
    docs = docs.unionByName(spark.createDataFrame(added, docs.schema)).repartition(3)
    want = filtered([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.materialize(stage(spark, kept, ""), "t")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert all(boiler not in t for _, t in want) and len([1 for i, _ in want if i >= 20_000]) == 1


def test_each_stage_takes_all_its_predecessor_kept(spark, tmp_path):
    """The run as a whole: pieces cover the documents of the mix, each as often as it was taken, whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), "t")
    copies = {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    text = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").distinct().collect()}
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    ids = {i: tokenizer.tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in text.items()}
    laid = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        laid[r["doc_id"]] += r["length"]
    assert laid == {i: n * len(ids[i]) for i, n in copies.items()}

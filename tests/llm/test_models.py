"""Clustering, resampling and the language model against brute force and odd tables."""

import hashlib
import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids, importance, markov

INF = float("inf")


# -- ball trees ------------------------------------------------------------------------------------


def brute_clusters(vectors, k=8, rounds=10):
    """``vectors``: (vec_id, list of 64 floats). Python whole numbers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(cents)):
            rows = [v for (_, v), o in zip(kept, own) if o == c]
            if rows:
                cents[c] = [sum(col) // len(rows) for col in zip(*rows)]
    own = assign()
    dist = [far(v, cents[o]) for (_, v), o in zip(kept, own)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i, o, d, sum(x for x, y in zip(dist, own) if y == o), sum(dist), sha[o]) for (i, _), o, d in zip(kept, own, dist))


def clustered(seed, n, groups=5, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((groups, 64))
    return [(i, (at[i % groups] + spread * rng.standard_normal(64)).tolist()) for i in range(n)]


def found_clusters(spark, rows, **parameters):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = centroids.with_inertia(*centroids.cluster(df, **parameters))
    return sorted(tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("seed, n, spread", [(0, 240, 0.02), (1, 150, 1.0), (2, 5, 0.1)])
def test_clusters_equal_brute_force(spark, seed, n, spread):
    rows = clustered(seed, n, spread=spread)
    rows += [(n + i, rows[0][1]) for i in range(30)]  # a group of copies
    rows += [(n + 50, [0.5] * 64), (n + 51, [-0.5] * 64), (n + 52, [1e5] * 64)]  # beyond exact products in doubles
    assert found_clusters(spark, rows, tree_rows=64, leaf_rows=4) == brute_clusters(rows)


def test_balls_are_taken_whole():
    """Most balls of clustered vectors go to one centroid as a whole, and those few left go to exact distances."""
    x = np.array([[math.floor(1024 * a) for a in v] for _, v in clustered(4, 2000, spread=0.01)], np.int64)
    order, nodes = centroids.ball_tree(x)
    assert sorted(order.tolist()) == list(range(2000))
    cents = x[:5]
    whole, owner, leaves = centroids.descend(nodes, cents)
    exact = centroids.squared_distances(x[order], cents).argmin(axis=1)
    for node, c in zip(whole, owner):
        assert (exact[nodes["start"][node] : nodes["end"][node]] == c).all()
    rows = sum(int(nodes["end"][i] - nodes["start"][i]) for i in leaves)
    assert rows < 400 and len(whole) < 40
    assert sum(int(nodes["end"][i] - nodes["start"][i]) for i in whole) + rows == 2000


def test_equal_starts_ties_and_odd_vectors(spark):
    one = [0.25] * 64
    rows = [(i, one) for i in range(12)] + [(None, one), (3, [0.5] * 64)]
    odd = [(90, None), (91, []), (92, one[:63]), (93, [None] + one[1:]), (94, [INF] + one[1:]), (95, [float("nan")] + one[1:]), (96, [3e5] + one[1:])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cluster", "of", "rows", "ids")})
    out = centroids.with_inertia(*centroids.cluster(df)).collect()
    assert len(out) == len(rows) and {r["vec_id"] for r in out} == {i for i, _ in rows}
    same = [r for r in out if r["distance"] == 0 and r["vec_id"] != 3]
    assert len({r["cluster"] for r in same}) == 1  # ties go to the smaller of equal centroids
    assert not centroids.with_inertia(*centroids.cluster(df.limit(0))).collect()


# -- CRC algebra -----------------------------------------------------------------------------------


def test_crcs_of_ngrams_without_their_strings():
    rng = np.random.default_rng(5)
    docs = [["".join(rng.choice(list("aé0z"), rng.integers(1, 9))) for _ in range(n)] for n in (0, 1, 2, 7, 30)] + [["w" * 70_000, "x", "y" * 300]]
    words = [w.encode() for d in docs for w in d]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    length, doc = np.array([len(w) for w in words]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    found = Counter((int(d), int(c)) for ds, cs in importance.ngram_crcs(crc, length, doc, 4) for d, c in zip(ds, cs))
    want = Counter((k, zlib.crc32(" ".join(d[i : i + n]).encode())) for k, d in enumerate(docs) for n in range(1, 5) for i in range(len(d) - n + 1))
    assert found == want


def brute_resample(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        words = (text or "").encode().translate(importance._word_bytes()).split()
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    own, aim = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aim for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(S + buckets) / ((s[b] + 1) * float(T + buckets))))
    rows = []
    for (i, _), (words, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = [(r[0], r[2], r[3], r[4], k + 1 if k < len(drawn) * percent // 100 else None) for k, r in enumerate(drawn)]
    return sorted(drawn + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < least], key=str)


@pytest.mark.parametrize("n, percent", [(1, 10), (3, 37), (2, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, n, percent):
    rng = np.random.default_rng(n)
    text = lambda i: " ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x9", "gamma-delta", "don't", "零"], rng.integers(0, 60)))
    docs = [(i, text(i)) for i in range(150)] + [(7, "seven " * 25), (7, "seven " * 25), (7, "other " * 25), (None, "none " * 30), (None, None), (900, ""), (901, "big " * 200_000)]
    target = [text(i) for i in range(9)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "id", "score", "rank", "n_words", "above")}).repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.importance_resample(df, aim, n=n, percent=percent, keep=("doc_id", "score"))
    found = sorted(((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()), key=str)
    assert found == brute_resample(docs, target, n=n, percent=percent)


def test_resampling_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "word " * 40)], "doc_id long, text string")
    assert not importance.importance_resample(none, some).collect()
    out = importance.importance_resample(some, none, percent=100)
    assert sorted((r["id"], r["rank"]) for r in out.collect()) == [(1, None), (2, 1)]


# -- hidden Markov model ---------------------------------------------------------------------------


def brute_likelihood(model, symbols):
    """Sum over all paths of states."""
    total = 0.0
    for path in product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emits[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            p *= model.moves[a, b] * model.emits[s, b]
        total += p
    return math.log(total)


def small_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    share = lambda *shape: rng.random(shape) + 0.05
    start, moves, emits = share(states), share(states, states), share(symbols, states)
    emits = emits / emits.sum(axis=0)
    return markov.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits, emits.mean(axis=1))


@pytest.mark.parametrize("kept", [1 << 20, 8])  # one piece; pieces of eight steps
def test_recursions_equal_all_paths(monkeypatch, kept):
    monkeypatch.setattr(markov, "KEPT", kept)
    model, rng = small_model(), np.random.default_rng(2)
    texts = [rng.integers(0, 5, n) for n in (1, 6, 3, 6, 2, 1, 9)]
    symbols = [t.astype("<u2").tobytes() for t in texts]
    want = [brute_likelihood(model, t) for t in texts]
    assert np.allclose(markov.log_likelihoods(model, symbols), want)
    found = markov.Expected(3, 5)
    found.add(model, symbols)
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        whole = math.exp(brute_likelihood(model, t))
        for path in product(range(3), repeat=len(t)):
            p = model.start[path[0]] * model.emits[t[0], path[0]]
            for a, b, s in zip(path, path[1:], t[1:]):
                p *= model.moves[a, b] * model.emits[s, b]
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for a, s in zip(path, t):
                emits[s, a] += p / whole
    assert np.allclose(found.start, start) and np.allclose(found.moves * model.moves, moves) and np.allclose(found.emits, emits)


def test_tasks_of_a_round():
    """Few for little, all cores for more, whole waves of them for much."""
    assert [markov.tasks_for(n, 6) for n in (0, 1, 300_000, 3_000_000, 40_000_000, 115_000_000)] == [1, 1, 2, 6, 6, 18]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(docs):
    counts, tokens = Counter(), lambda t: (t or "").encode().lower().split() + [b""]
    for i, t in docs:
        if i is not None and not held_out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {
        (i, t): (len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for i, t in docs
    }


def topics(n):
    """Texts of two vocabularies, never mixed."""
    rng = np.random.default_rng(8)
    sets = [[f"{c}{k}" for k in range(40)] for c in "ab"]
    return [(i, " ".join(rng.choice(sets[i % 2], 60))) for i in range(n)]


@pytest.mark.parametrize("symbols, lookup", [(65_000, 200_000), (30, 50), (5, 7)])
def test_scores_of_texts(spark, symbols, lookup):
    odd = [(500, None), (501, ""), (None, "a1 b2"), (503, "never " + "Z" * 200 + " a3"), (503, "a1 a1 unseen b7"), (504, "word " * 3000), (505, "É ñ A1")]
    docs = topics(120) + odd
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "n", "word", "base", "of", "symbols")}).repartition(3)
    out = markov.score_texts(df, states=4, rounds=6, symbols=symbols, lookup=lookup, prior=5.0).collect()
    want = brute_base(docs)
    by = {(r["doc_id"], r["n_tokens"]): r for r in out}
    assert len(out) == len(docs)
    for (i, t), (n, known, total, base) in want.items():
        r = by[i, n]
        assert (r["n_known"], r["train_tokens"], r["held_out"]) == (known, total, held_out(i)) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    tests = [r for r in out if r["held_out"] and r["n_tokens"] == 61]
    gain = sum(r["score"] - r["base_score"] for r in tests) / sum(r["n_tokens"] for r in tests)
    assert gain > (0.2 if symbols > 80 else 0.0)  # two vocabularies apart save up to log10(2) a token


def test_probabilities_sum_to_one(spark):
    """All texts of up to one known word, and an unseen one for each class, have the model's whole probability of such texts."""
    docs = [(i, w) for i, w in enumerate(["ab", "cb", "ab cb", "ad", "ab ab", "ad cb"]) if not held_out(i)]
    counts = markov.token_counts(spark.createDataFrame(docs, "doc_id long, text string"))
    v = markov.Vocabulary(counts, symbols=1, lookup=10)
    assert math.isclose(v.overall.sum(), 1.0)
    known = sum(10 ** v.share[i] * (v.overall[v.symbol[i]]) for i in range(len(v.ids)))
    unseen = sum(v.overall[1 + b] / v.class_size[b] for b in range(256))
    assert math.isclose(known + unseen + v.overall[0], 1.0)


def test_language_model_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not markov.score_texts(none).collect()
    only = next(i for i in range(100) if held_out(i))
    out = markov.score_texts(spark.createDataFrame([(only, "no training text"), (None, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["train_tokens"], r["n_known"], r["base_score"]) for r in out} == {(only, 0, 0, 0.0), (None, 0, 0, 0.0)}
    assert all(r["score"] < 0 for r in out)

"""Language identification by hierarchical discrimination.

A text is lower-cased and reduced to letters and blanks; its features are relative frequencies of
hashed byte n-grams, square-rooted and scaled to unit length. The first level picks a language
family; within the family, one-versus-one linear support vector machines vote on the language.

Training: about ``TRAIN_DOCS`` labelled texts for each language (``TRAIN_TOTAL`` in all), drawn by a seeded
hash of ``doc_id``, so that the sample is bounded, spread over the table and the same in any run. Features
are computed on executors; the driver gets that bounded sample of vectors and fits the machines by
dual coordinate descent. Families are a fixed table; languages it lacks are a family of their own.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if no
text is labelled; with one language learned, that is predicted with the family's score; null labels
and null ids train nothing; ``held_out`` of a null id is false; repeated rows get equal results; only
``doc_id``, ``text`` and ``lang`` are read, ``lang`` for training alone.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices, table

FOLDS = 5
TRAIN_DOCS = 400
TRAIN_TOTAL = 4_000
DIMENSIONS = 4_096
NGRAMS = (1, 2, 3)
SEED = 77

# Language families by code.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
    "semitic": "ar he mt".split(),
}

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _letter_ranges() -> str:
    """The letters up to U+FFFF as ranges of a character class; ``re`` keeps such a class as one bitmap."""
    letter = [chr(c).isalpha() for c in range(0x10000)]
    starts = [c for c in range(0x10000) if letter[c] and not (c and letter[c - 1])]
    ends = [c for c in range(0x10000) if letter[c] and not (c < 0xFFFF and letter[c + 1])]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_NOT_LETTERS = re.compile(f"[^{_letter_ranges()}]+")


def letters_of(text: str | None) -> str:
    """The letters of a text in lower case, runs of anything else as one blank."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii() and _ASTRAL.search(text):
        text = "".join(c if c.isalpha() else " " for c in text)
        return " ".join(text.split())
    return _NOT_LETTERS.sub(" ", text).strip()


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), f"only {lang}")


def features(texts: list[str | None], dimensions: int, ngrams=NGRAMS) -> np.ndarray:
    """One unit row for each text; a text without letters is a row of zeros."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for i, text in enumerate(texts):
        letters = letters_of(text)
        if not letters:
            continue
        data = np.frombuffer(f" {letters} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
        total = np.zeros(dimensions)
        for n in ngrams:
            h = np.full(len(data) - n + 1, np.uint32(n))
            for k in range(n):
                h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((h ^ (h >> np.uint32(13))) % np.uint32(dimensions), minlength=dimensions) / len(h)
        row = np.sqrt(total)
        out[i] = row / np.sqrt(row @ row)
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = SEED) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent (squared hinge); the bias is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    # classes weigh the same, however many examples they have
    penalty = 0.5 / (cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())))
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diagonal = np.einsum("ij,ij->i", x, x) + penalty
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + penalty[i] * alpha[i]) / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w.astype(np.float32)


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Families, one machine for each family against the rest, and for each pair of languages within one."""
    lang = np.array(langs, dtype=object)
    known = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for name in known:
        groups.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(x) for x in langs], dtype=object)
    model = {"groups": groups, "families": sorted(groups), "first": [], "pairs": {}}
    if len(groups) > 1:
        model["first"] = [fit_machine(x, np.where(family == f, 1, -1)) for f in model["families"]]
    for members in groups.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                both = (lang == a) | (lang == b)
                model["pairs"][a, b] = fit_machine(x[both], np.where(lang[both] == a, 1, -1))
    return model


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))


def classify(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row: the family's share of chance times the mean chance of the votes won."""
    n = len(x)
    langs, scores = ["und"] * n, np.zeros(n)
    some = x.any(axis=1)
    families = model["families"]
    if not families:
        return langs, scores
    if len(families) > 1:
        chances = _chance(np.stack([x @ w[:-1] + w[-1] for w in model["first"]], axis=1))
        picked = chances.argmax(axis=1)
        sure = chances.max(axis=1) / chances.sum(axis=1)
    else:
        picked, sure = np.zeros(n, dtype=int), np.ones(n)
    for f, name in enumerate(families):
        rows = np.flatnonzero(some & (picked == f))
        members = model["groups"][name]
        votes = np.zeros((len(rows), len(members)))
        chance = np.zeros((len(rows), len(members)))
        for i, a in enumerate(members):
            for j in range(i + 1, len(members)):
                w = model["pairs"][a, members[j]]
                p = _chance(x[rows] @ w[:-1] + w[-1])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                chance[:, i] += p
                chance[:, j] += 1 - p
        best = (votes + chance / (2 * len(members))).argmax(axis=1)
        within = chance[np.arange(len(rows)), best] / (len(members) - 1) if len(members) > 1 else np.ones(len(rows))
        for r, b in zip(rows, best):
            langs[r] = members[b]
        scores[rows] = sure[rows] * within
    return langs, np.clip(scores, 0.0, 1.0)


def _vectors(batches, dimensions: int):
    for batch in slices(batches, "text"):
        rows = features(batch.column("text").to_pylist(), dimensions)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "vector"]
        )


def train(
    docs: DataFrame, folds=FOLDS, train_docs=TRAIN_DOCS, train_total=TRAIN_TOTAL, dimensions=DIMENSIONS, seed=SEED
) -> dict:
    """A model from the labelled texts outside the held-out fold."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(folds) != 0)
    labelled = docs.where(usable).select(
        F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(2**30)).alias("draw")
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a number for each language
    if not counts:
        return fit(np.zeros((0, dimensions), dtype=np.float32), [])
    quota = max(1, min(train_docs, train_total // len(counts)))
    in_sample = F.lit(False)
    for lang, count in sorted(counts.items()):
        in_sample = in_sample | ((F.col("lang") == F.lit(lang)) & (F.col("draw") < F.lit(int(2**30 * min(1.0, quota / count)))))
    sample = arrow_map(labelled.where(in_sample).select("lang", "text"), _vectors, "lang string, vector binary", dimensions=dimensions)
    # copies of a row are drawn together, so their number has a bound of its own
    rows = sorted((r["lang"], bytes(r["vector"])) for r in islice(sample.toLocalIterator(), 4 * quota * len(counts)))
    x = np.frombuffer(b"".join(v for _, v in rows), dtype=np.float32).reshape(-1, dimensions)
    some = x.any(axis=1)
    return fit(x[some], [rows[i][0] for i in np.flatnonzero(some)])


def _remainder(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def _predict(batches, model, text: str, keep: list[str], names: list[str], dimensions: int):
    model = model.value
    for batch in slices(batches, text):
        langs, scores = classify(model, features(batch.column(text).to_pylist(), dimensions))
        columns = [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])


def predict(
    docs: DataFrame, model: dict, keep: list[str], text: str = "text", dimensions=DIMENSIONS, names=("lang_pred", "lang_score")
) -> DataFrame:
    """``keep`` columns with two more, ``names``: language and score, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs within them) x dimensions numbers
    rows = docs.select(*dict.fromkeys([*keep, text]))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    schema = f"{fields}`{names[0]}` string, `{names[1]}` double"
    return arrow_map(rows, _predict, schema, model=shared, text=text, keep=keep, names=list(names), dimensions=dimensions)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs), ["doc_id"])
    held_out = F.coalesce(_remainder(FOLDS) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}

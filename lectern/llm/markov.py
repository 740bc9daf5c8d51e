"""Scoring by a hidden Markov language model trained with Baum-Welch over all training texts.

Tokens are words with A-Z in lower case, then one end. Counts of all tokens are summed in each task, then by word. The
model emits symbols: one for each of the ``SYMBOLS`` commonest words, one for the end, and one for each class of the other
words, by their last byte; given its class, a word has probability ``(c + 1) / (tokens + types + 1)`` of the class, the added one for words
never seen. So the latent states' tables have a bounded size whatever the vocabulary, and every word keeps a probability of its own.

Texts become arrays of symbols once, in a table in the shared folder. Each round of Baum-Welch reads it: tasks run the scaled
forward and backward recursions over texts of like length side by side and send expected counts by symbol, which Spark sums; the new
model is broadcast. Emissions are smoothed towards the words' overall frequencies, so with one state the model is the base model. The
score is the log of the exact sequence likelihood, from the scales of the forward recursion, plus the words' shares of their classes.

Words beyond the ``LOOKUP`` commonest are counted by a join on the word, as their table grows with the corpus.

Defined results: a null or empty text is one end token; a null id trains nothing and isn't held out; rows that repeat an id are texts of
their own; with no training text all words are unseen and the model is uniform; an empty table gives an empty result; texts of any
length are taken whole, the recursions keeping states only at the borders of pieces; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices, table

FOLDS, HELD_OUT = 7, 2
STATES = 8
ROUNDS = 6
SYMBOLS = 65_000
LOOKUP = 200_000
#: Words longer than this many bytes are looked up by the join, so that the table in memory has a bound in bytes too.
LONGEST = 64
#: Weight of the words' overall frequencies in the emissions of a state, in tokens.
PRIOR = 200.0
SEED = 11
#: Tokens of texts scored side by side, and numbers kept for a backward recursion.
BATCH_TOKENS, KEPT = 1 << 19, 1 << 23
#: Tokens that a task of a round should have at most, where there are tasks enough for all cores, and at least.
TASK_TOKENS, LEAST_TOKENS = 1 << 23, 1 << 18
#: Steps between two scalings of the recursions.
SCALED = 8
CLASSES = 256
#: Rows of expected counts that aren't symbols.
START, MOVES = -1, -2


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text; the end is not among them."""
    return text.lower().split() if text else []


def _remainder(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


# -- counts ----------------------------------------------------------------------------------------


def _counted(batches, most: int = 300_000):
    """Words and their numbers, summed over what a task has read; the end is the word without bytes."""
    held: Counter = Counter()

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return rows

    for batch in slices(batches, "text"):
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            held.update(tokens_of(text))
        held[b""] += batch.num_rows
        if len(held) > most:
            yield out()
    yield out()


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n`` over all texts; the word without bytes is the end."""
    own = texts.select(F.col(text).cast("string").alias("text"))
    counts = arrow_map(own, _counted, "word binary, n long").where("n > 0")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _class_of(word):
    """The last byte of a word column."""
    return F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")


class Vocabulary:
    """The commonest words with their symbols and logs, and the statistics of all others by class."""

    def __init__(self, counts: DataFrame, symbols: int = SYMBOLS, lookup: int = LOOKUP, longest: int = LONGEST):
        size = F.length("word")
        # the least count that at most ``lookup`` words have, in steps of a fourth root of two: one row
        steps = [math.ceil(2 ** (i / 4)) for i in range(4 * 48)]
        short = (size > 0) & (size <= longest)
        row = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(size == 0, F.col("n"))), F.lit(0)),
            F.array(*[F.count_if(short & (F.col("n") >= s)) for s in steps]),
        ).first()
        self.tokens, self.types, ends = row[0], row[1], row[2]
        least = next(s for s, n in zip(steps, row[3]) if n <= lookup)
        found = counts.where(short & (F.col("n") >= least)).toArrow()
        common = sorted(zip(found.column("n").to_pylist(), found.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
        by_class = counts.where(size > 0).groupBy(_class_of(F.col("word")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
        rest = np.zeros((CLASSES, 2), np.int64)
        for r in by_class.collect():  # a row for each byte
            rest[r["class"]] = r["n"], r["types"]
        for n, word in common[:symbols]:
            rest[word[-1]] -= n, 1
        self.class_size = rest.sum(axis=1) + 1
        self.ids = {word: i for i, (_, word) in enumerate(common)}
        count = np.array([n for n, _ in common], np.float64)
        kind = np.array([word[-1] for _, word in common], np.int64)
        own = np.arange(len(common)) < symbols
        #: Symbols: 0 the end, then the classes, then the words of their own.
        self.symbol = np.where(own, 1 + CLASSES + np.arange(len(common)), 1 + kind).astype(np.uint16)
        self.base = np.log10((count + 1) / (self.tokens + self.types + 1))
        self.share = np.where(own, 0.0, np.log10((count + 1) / self.class_size[kind]))
        self.end = float(np.log10((ends + 1) / (self.tokens + self.types + 1))), bool(ends)
        self.overall = np.concatenate(([ends + 1], self.class_size, count[:symbols] + 1)) / (self.tokens + self.types + CLASSES)
        self.overall = self.overall / self.overall.sum()


def _encoded(batches, vocabulary):
    v = vocabulary.value
    find = v.ids.get
    for batch in slices(batches, "text"):
        out: dict[str, list] = {c: [] for c in ("symbols", "n_known", "base", "share", "rare")}
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = tokens_of(text)
            at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
            rare = np.flatnonzero(at < 0)
            at = np.maximum(at, 0) if len(v.symbol) else at
            symbols = np.zeros(len(words) + 1, "<u2")
            base, share = np.zeros(len(words)), np.zeros(len(words))
            if len(v.symbol):
                symbols[:-1], base, share = v.symbol[at], v.base[at], v.share[at]
            base[rare] = share[rare] = 0.0
            for i in rare:
                symbols[i] = 1 + words[i][-1]
            found = Counter(words[i] for i in rare)
            for name, value in zip(
                out, (symbols.tobytes(), len(words) - len(rare) + v.end[1], float(base.sum()) + v.end[0], float(share.sum()), list(found.items()))
            ):
                out[name].append(value)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out["rare"]]))).astype(np.int32)
        pairs = [p for x in out["rare"] for p in x]
        struct = pa.StructArray.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])
        n = np.array([len(x) // 2 for x in out["symbols"]], np.int64)
        columns = [
            *(batch.column(c) for c in ("row", "doc_id", "held_out", "trains")), pa.array(n), pa.array(out["symbols"], pa.binary()), pa.array(out["n_known"], pa.int64()),
            pa.array(out["base"], pa.float64()), pa.array(out["share"], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), struct),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


_COLUMNS = ["row", "doc_id", "held_out", "trains", "n_tokens", "symbols", "n_known", "base", "share", "rare"]
_ENCODED = (
    "row long, doc_id long, held_out boolean, trains boolean, n_tokens long, symbols binary, n_known long, base double, share double, "
    "rare array<struct<word: binary, n: long>>"
)


def encode(docs: DataFrame, vocabulary: Vocabulary, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row for each document: its symbols, and the sums of logs over its words as far as they are in memory; the ``rare`` others."""
    rest = _remainder(folds)
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), F.coalesce(rest != held_out, F.lit(False)).alias("trains"),
        F.col("text").cast("string").alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # ``LOOKUP`` words of ``LONGEST`` bytes at most
    return arrow_map(own, _encoded, _ENCODED, vocabulary=shared)


# -- recursions ------------------------------------------------------------------------------------


class Model:
    """Start, moves between states (rows sum to one) and, for each symbol, its probability in each state.

    The recursions take a symbol's probability relative to its ``overall`` one, so that states need scaling only every ``SCALED`` steps.
    """

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, overall: np.ndarray):
        self.start, self.moves, self.ratio, self.log_overall = start, moves, emits / overall[:, None], np.log(overall)

    @property
    def emits(self) -> np.ndarray:
        return self.ratio * np.exp(self.log_overall)[:, None]


def first_model(overall: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """States that mostly stay, with the overall frequencies, each symbol's changed by a seeded factor."""
    rng = np.random.default_rng(seed)
    emits = overall[:, None] * rng.gamma(2.0, size=(len(overall), states))
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=0), overall)


class Texts:
    """Texts side by side: ``order`` by falling length, ``steps`` (step, text) of symbols, and how many texts have each step."""

    def __init__(self, symbols: list[bytes]):
        texts = [np.frombuffer(s, "<u2") for s in symbols]
        length = np.array([len(t) for t in texts])
        self.order = np.argsort(-length, kind="stable")
        self.steps = np.zeros((int(length.max()), len(texts)), "<u2")
        for j, i in enumerate(self.order):
            self.steps[: length[i], j] = texts[i]
        self.active = np.append(len(texts) - np.searchsorted(np.sort(length), np.arange(len(self.steps)), side="right"), 0)


def _forward(model: Model, texts: Texts, first: int, last: int, now: np.ndarray | None, logs: np.ndarray, keep: np.ndarray | None = None, scales: dict | None = None):
    """State probabilities after step ``last - 1``, up to a factor whose log is in ``logs``; ``now`` are those before ``first``, none at the start.

    A text that ends here has its log likelihood, relative to overall frequencies, in ``logs``.
    """
    for t in range(first, last):
        n, after = texts.active[t], texts.active[t + 1]
        ratio = model.ratio.take(texts.steps[t, :n], axis=0)
        now = model.start * ratio if now is None else np.multiply(now[:n] @ model.moves, ratio, out=ratio)
        if t % SCALED == SCALED - 1:
            scale = now.sum(axis=1)
            now /= scale[:, None]
            logs[:n] += np.log(scale)
            if scales is not None:
                scales[t] = scale[:, None]
        if after < n:
            logs[after:n] += np.log(now[after:].sum(axis=1))
        if keep is not None:
            keep[t - first, :n] = now
            keep[t - first, n:] = 0.0
    return now


def _overall(model: Model, texts: Texts) -> np.ndarray:
    """Log probability of each text by overall frequencies alone."""
    out, steps = np.zeros(texts.steps.shape[1]), len(texts.steps)
    piece = max(1, KEPT // len(out))
    for at in range(0, steps, piece):
        logs = model.log_overall[texts.steps[at : at + piece]]
        out += np.where(np.arange(len(out)) < texts.active[at : at + len(logs), None], logs, 0.0).sum(axis=0)
    return out


def log_likelihoods(model: Model, symbols: list[bytes]) -> np.ndarray:
    """Natural logs of the exact likelihoods of the texts."""
    texts = Texts(symbols)
    logs = _overall(model, texts)
    _forward(model, texts, 0, len(texts.steps), None, logs)
    out = np.zeros(len(symbols))
    out[texts.order] = logs
    return out


class Expected:
    """Expected counts of starts, moves and emissions."""

    def __init__(self, states: int, symbols: int):
        self.start, self.moves, self.emits = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        self._kept = np.zeros(0)

    def _room(self, *shape: int) -> np.ndarray:
        """An array of that shape, in memory that is used again and again; what it holds is left from before."""
        size = math.prod(shape)
        if size > len(self._kept):
            self._kept = np.zeros(size)
        return self._kept[:size].reshape(shape)

    def add(self, model: Model, symbols: list[bytes]) -> None:
        """One forward pass that keeps the states at the borders of pieces, then each piece again, backwards."""
        texts = Texts(symbols)
        states, (steps, width) = len(model.start), texts.steps.shape
        piece = max(1, KEPT // (width * states * SCALED)) * SCALED
        borders: list[np.ndarray | None] = [None]
        for at in range(0, steps - piece, piece):
            borders.append(_forward(model, texts, at, at + piece, borders[-1], np.zeros(width)))
        after = follow = np.ones((width, states))  # what the rest of a text gives each state now, and each state it moves to
        for k in range(len(borders) - 1, -1, -1):
            first, last = k * piece, min(steps, (k + 1) * piece)
            scales: dict[int, np.ndarray] = {}
            kept = self._room(last - first, width, states)
            _forward(model, texts, first, last, borders[k], np.zeros(width), kept, scales)
            for t in range(last - 1, first - 1, -1):
                now, n, later = kept[t - first], texts.active[t], texts.active[t + 1]
                if later:
                    self.moves += now[:later].T @ follow[:later]
                    np.matmul(follow[:later], model.moves.T, out=after[:later])
                if later < n:  # so that a text's probabilities sum to one at each of its steps
                    after[later:n] = 1 / now[later:n].sum(axis=1, keepdims=True)
                follow = model.ratio.take(texts.steps[t, :n], axis=0)
                follow *= after[:n]
                if t in scales:
                    follow /= scales[t]
                now[:n] *= after[:n]
            if k == 0:
                self.start += kept[0].sum(axis=0)
            flat, weight = texts.steps[first:last].reshape(-1).astype(np.int64), kept.reshape(-1, states)
            for s in range(states):
                self.emits[:, s] += np.bincount(flat, weight[:, s], len(self.emits))


def alike(batches, column: str = "symbols", tokens: int = BATCH_TOKENS):
    """Batches of about ``tokens`` symbols, padding included, as long as rows come in order of length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(column).offset)) // 2
        start = most = 0
        for i, n in enumerate(length.tolist()):
            if i > start and max(most, n) * (i + 1 - start) > tokens:
                yield batch.slice(start, i - start)
                start, most = i, 0
            most = max(most, n)
        yield batch.slice(start)


def _expected(batches, model, symbols: int):
    """Expected counts of a task: ``symbol`` and a number for each state."""
    model = model.value
    found = Expected(len(model.start), symbols)
    for batch in alike(batches):
        found.add(model, batch.column("symbols").to_pylist())
    some = np.flatnonzero(found.emits.any(axis=1))
    moves = found.moves * model.moves
    ids = np.concatenate((some, [START], MOVES - np.arange(len(moves)))).astype(np.int32)
    rows = np.concatenate((found.emits[some], found.start[None], moves)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["symbol", "n"])


def maximised(expected: Expected, overall: np.ndarray, prior: float = PRIOR) -> Model:
    """The model of expected counts; emissions lean to the overall frequencies as if those had been seen ``prior`` times."""
    start, moves, emits = expected.start + 1.0, expected.moves + 1.0, expected.emits + prior * overall[:, None]
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0), overall)


def tasks_for(tokens: int, cores: int) -> int:
    """Tasks of a round: each sends a number for each symbol and state, so it should have read enough; whole waves of all cores, fewer for little."""
    return max(1, min(cores * -(-tokens // (TASK_TOKENS * cores)), -(-tokens // LEAST_TOKENS)))


def train(encoded: DataFrame, overall: np.ndarray, tokens: int, states: int = STATES, rounds: int = ROUNDS, prior: float = PRIOR, seed: int = SEED) -> Model:
    """Baum-Welch over all training rows of ``encoded``, which hold so many ``tokens``."""
    model = first_model(overall, states, seed)
    texts = encoded.where("trains").select("symbols").coalesce(tasks_for(tokens, encoded.sparkSession.sparkContext.defaultParallelism))
    for _ in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(model)  # ``SYMBOLS`` x states numbers
        found = arrow_map(texts, _expected, "symbol int, n array<float>", model=shared, symbols=len(overall))
        summed = found.groupBy("symbol").agg(*[F.sum(F.col("n")[k].cast("double")).alias(f"n{k}") for k in range(states)])
        sums = summed.toArrow()  # a row for each symbol and state
        expected = Expected(states, len(overall))
        symbol, n = sums.column("symbol").to_numpy(), np.stack([sums.column(f"n{k}").to_numpy() for k in range(states)], axis=1)
        expected.emits[symbol[symbol >= 0]] = n[symbol >= 0]
        expected.start += n[symbol == START].sum(axis=0)
        expected.moves[MOVES - symbol[symbol <= MOVES]] = n[symbol <= MOVES]
        model = maximised(expected, overall, prior)
        shared.destroy()
    return model


def _scored(batches, model):
    model = model.value
    for batch in alike(batches):
        score = log_likelihoods(model, batch.column("symbols").to_pylist()) / math.log(10)
        columns = [*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(score + batch.column("share").to_numpy())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])


def score_texts(
    docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, lookup: int = LOOKUP, prior: float = PRIOR, seed: int = SEED
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row of ``docs``."""
    counts = materialize(token_counts(docs.where(_remainder(FOLDS) != HELD_OUT)), "token-counts")
    v = Vocabulary(counts, symbols, lookup)
    encoded = materialize(encode(docs, v).sortWithinPartitions("n_tokens"), "symbols")
    model = train(encoded, v.overall, v.tokens, states, rounds, prior, seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "symbols")
    scored = arrow_map(texts, _scored, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double", model=shared)
    rare = encoded.select(F.col("row").alias("of"), F.explode("rare").alias("r")).select("of", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    in_class = F.element_at(F.array(*[F.lit(float(x)) for x in v.class_size]), _class_of(F.col("word")) + 1)
    looked_up = rare.join(counts, "word", "left").groupBy("of").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(v.tokens + v.types + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 1) / in_class)).alias("rare_share"),
    )
    return scored.join(looked_up, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_share", F.lit(0.0))).alias("score"),
    )


def op11_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op11_markov": op11_markov}
ORACLES: dict[str, str] = {}

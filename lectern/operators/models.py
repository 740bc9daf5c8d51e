"""Calls of models that can fail: batches of rows, tries, a budget, an error for each row that got nothing, and what stands in for it.

A model is a plain function of a list of texts that gives as many values, or raises. It runs in tasks, over Arrow batches, so calls
go on side by side and no row waits on the driver. A batch that fails is tried again, longer pauses between; if it fails for good, its
texts are asked one by one, so a text that a model can't take fails alone. A lost task calls again for its rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.embedding import EMBEDDERS
from lectern.functions.text import col, offline_answer, trim

#: What an embedder is given for a text that holds nothing.
INVALID = "invalid input"
SPENT = "no calls left"


@dataclass(frozen=True)
class Calls:
    """How a model is called: texts of a call, tries of each, seconds before a second try (twice as many before each further one), seconds between calls,
    calls that one task may make (all it needs, if None), and whether texts of a failed batch are asked one by one."""

    batch: int = 16
    tries: int = 3
    wait: float = 0.0
    pause: float = 0.0
    most: int | None = None
    alone: bool = True


class Caller:
    """Calls one model for one task and counts."""

    def __init__(self, call: Callable[[list[str]], list], how: Calls, sound: Callable[[object], bool] | None = None):
        self.call, self.how, self.sound, self.made = call, how, sound, 0

    def _once(self, texts: list[str]) -> tuple[list, str | None, int]:
        """Values, or why there are none, after how many tries."""
        problem = SPENT
        for n in range(1, self.how.tries + 1):
            if self.how.most is not None and self.made >= self.how.most:
                return [], problem if n > 1 else SPENT, n - 1
            if n > 1 and self.how.wait:
                time.sleep(self.how.wait * 2 ** (n - 2))
            elif self.made and self.how.pause:
                time.sleep(self.how.pause)
            self.made += 1
            try:
                values = list(self.call(texts))
                if len(values) != len(texts):
                    raise ValueError(f"{len(values)} values for {len(texts)} texts")
                return values, None, n
            except Exception as e:  # whatever a model raises, its rows are reported, not the job failed
                problem = f"{type(e).__name__}: {e}"
        return [], problem, self.how.tries

    def run(self, texts: list[str | None]) -> list[tuple[object, str | None, int]]:
        """Value, error and tries of each text; a null text is not asked."""
        out: list = [(None, None, 0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(asked), self.how.batch):
            part = asked[at : at + self.how.batch]
            values, problem, n = self._once([texts[i] for i in part])
            if problem is None:
                out_of = zip(part, values)
                for i, value in out_of:
                    out[i] = (value, None, n) if self.sound is None or self.sound(value) else (None, "unusable value", n)
            elif self.how.alone and len(part) > 1 and problem != SPENT:
                for i in part:
                    values, alone, m = self._once([texts[i]])
                    good = alone is None and (self.sound is None or self.sound(values[0]))
                    out[i] = (values[0], None, n + m) if good else (None, alone or "unusable value", n + m)
            else:
                for i in part:
                    out[i] = (None, problem, n)
        return out


_TYPES = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "long": pa.int64()}


def call_model(rows: DataFrame, text: str, call: Callable[[list[str]], list], kind: str = "string", how: Calls = Calls(), sound: Callable[[object], bool] | None = None) -> DataFrame:
    """``rows`` with ``value`` (of ``kind``), ``error`` and ``tries``; one call's texts come from one task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        caller = Caller(call, how, sound)
        for big in batches:
            for at in range(0, big.num_rows, 64 * how.batch):
                batch = big.slice(at, 64 * how.batch)
                found = caller.run(batch.column(text).to_pylist())
                value, error, tries = (list(c) for c in zip(*found)) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(value, _TYPES[kind]), pa.array(error, pa.string()), pa.array(tries, pa.int32())],
                    names=[*batch.schema.names, "value", "error", "tries"],
                )

    return rows.mapInArrow(run, f"{fields}, value {kind}, error string, tries int")


def finite_vector(value) -> bool:
    """Whether a reply is a vector: some numbers, all finite."""
    try:
        return len(value) > 0 and all(float("-inf") < float(x) < float("inf") for x in value)
    except (TypeError, ValueError):
        return False


def embed_with_model(rows: DataFrame, text: str, call: Callable[[list[str]], list] | None, local: str = "fallback", how: Calls = Calls(), most_chars: int | None = None, blanks: bool = False) -> DataFrame:
    """``rows`` with ``embedding``, ``made_by`` (``model``, ``local``, or ``invalid`` for a text that holds nothing) and ``error``.

    A text that the model gave no vector for is embedded locally, as all are if there is no model (``call`` None). Models that take no more than
    ``most_chars`` get as much of a text; the local embedder has it whole. Models that take empty texts and white space get these too with ``blanks``;
    only a null text is invalid then.
    """
    blank = col(text).isNull() if blanks else trim(F.coalesce(col(text), F.lit(""))) == ""
    asked = rows.withColumn("_whole", F.when(~blank, F.col(text)))
    asked = asked.withColumn("_asked", F.substring("_whole", 1, most_chars) if most_chars else F.col("_whole"))
    if call is None:
        found = asked.withColumns({"value": F.lit(None).cast("array<double>"), "error": F.lit(None).cast("string"), "tries": F.lit(0)})
    else:
        found = call_model(asked, "_asked", call, "array<double>", how, finite_vector)
    # local vectors are made of what the model left; others hand it an empty text
    left = F.when(F.col("value").isNull(), F.coalesce("_whole", F.lit(INVALID))).otherwise("")
    made_by = F.when(F.col("value").isNotNull(), "model").when(F.col("_asked").isNull(), "invalid").otherwise("local")
    vector = F.coalesce("value", EMBEDDERS[local](left))
    return found.withColumn("embedding", vector).withColumn("made_by", made_by).drop("_asked", "_whole", "value", "tries")


def generator(call: Callable[[list[str]], list], how: Calls = Calls(), otherwise: Callable[[Column], Column] = offline_answer) -> Callable[[Column], Column]:
    """A ``generate`` for ``ask``: the model's text, or what ``otherwise`` says of the prompt where it gave none."""

    @F.arrow_udf("string")
    def said(prompts: pa.Array) -> pa.Array:
        return pa.array([value for value, _, _ in Caller(call, how, lambda v: isinstance(v, str)).run(prompts.to_pylist())], pa.string())

    return lambda prompt: F.coalesce(said(prompt), otherwise(prompt))


def probe_model(spark, call: Callable[[list[str]], list], how: Calls = Calls(tries=1)) -> DataFrame:
    """One row: whether a model answers, with ``error`` and seconds; asked in a task, where it would be called from."""

    def run(batches):
        for batch in batches:
            began = time.perf_counter()
            ((value, error, _),) = Caller(call, how).run(["ping"])
            yield pa.RecordBatch.from_pydict({"ok": [error is None], "error": pa.array([error], pa.string()), "seconds": [time.perf_counter() - began]})

    return spark.range(1, numPartitions=1).mapInArrow(run, "ok boolean, error string, seconds double")

"""Embeddings that need no model: character and word hashes.

``simple_hash`` is a column expression. The embeddings are Arrow functions over blocks of texts: the characters of a block are
counted by text and kind in one pass, and hashes of its words come from running sums, so no text or word is looked at alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col


def simple_hash(text) -> Column:
    """``abs`` of the 32-bit hash ``31 * h + code``."""
    codes = F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda h: F.pmod(h + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c)))


#: Texts and characters of a block, and counts that it may hold.
BLOCK_ROWS, BLOCK_CHARS, BLOCK_COUNTS = 256, 1 << 20, 1 << 22
_THREE = ((1, 0.1), (3, 0.05), (7, 0.02))
#: What splits words: the blanks of Unicode, all below this table's end.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


@lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of 31, and of its inverse, as 32 bits."""
    both = np.full((2, size), 31, np.uint32)
    both[1] = pow(31, -1, 2**32)
    both[:, 0] = 1
    return tuple(np.cumprod(both, axis=1, dtype=np.uint32))


def _raw_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash ``31 * h + code`` of each span of codes, as 32 bits without a sign."""
    up, down = _powers_of(1 << max(16, int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint32)
    np.cumsum(codes.astype(np.uint32) * down[: len(codes)], dtype=np.uint32, out=sums[1:])
    return ((sums[ends] - sums[starts]) * up[np.maximum(ends - 1, 0)]).astype(np.int64)


def _spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the texts, one after the other, and where each starts and ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return _codes("".join(texts)), np.concatenate([[0], ends[:-1]]), ends


def _raw_hash(text: str) -> int:
    return int(_raw_hashes(*_spans([text]))[0])


def _signed(h):
    return np.abs((np.asarray(h, np.int64) + 2**31) % 2**32 - 2**31)


def _hash(text: str) -> int:
    return int(_signed(_raw_hash(text)))


def _tapped(texts: list[str], dimension: int, taps=_THREE) -> np.ndarray:
    """For each text and tap the sums of ``weight * code`` by ``code * factor % dimension``."""
    codes, starts, ends = _spans(texts)
    n, out = len(texts), np.zeros(len(texts) * dimension)
    if not len(codes):
        return out.reshape(n, dimension)
    kinds = np.flatnonzero(np.bincount(codes))
    if n > 1 and n * len(kinds) > BLOCK_COUNTS:
        return np.concatenate([_tapped(texts[: n // 2], dimension, taps), _tapped(texts[n // 2 :], dimension, taps)])
    place = np.zeros(kinds[-1] + 1, np.int64)
    place[kinds] = np.arange(len(kinds))
    counts = np.bincount(np.repeat(np.arange(n) * len(kinds), ends - starts) + place[codes], minlength=n * len(kinds))
    found = np.flatnonzero(counts)
    code, row = kinds[found % len(kinds)], found // len(kinds) * dimension
    for factor, weight in taps:
        out += np.bincount(row + code * factor % dimension, counts[found] * code * weight, n * dimension)
    return out.reshape(n, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=x, where=size > 0)


def _plain(texts: list[str | None], dimension: int) -> np.ndarray:
    return _tapped([t or "" for t in texts], dimension, ((1, 1 / 128),))


def _character(texts: list[str | None], dimension: int) -> np.ndarray:
    return _unit(_tapped([t or "" for t in texts], dimension, ((1, 0.1),)))


def _fallback(texts: list[str | None], dimension: int) -> np.ndarray:
    texts = [t if t and t.strip() else "default text" for t in texts]
    out = _tapped([t.lower().strip() for t in texts], dimension)
    factors, ends = _numbered(dimension)
    out[:, ::10] += _signed((_raw_hashes(*_spans(texts))[:, None] * factors + ends) % 2**32) % 100 * 0.001
    return _unit(out)


@lru_cache
def _numbered(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tenth number what its digits multiply a hash by and add to it."""
    names = [str(i) for i in range(0, dimension, 10)]
    return np.array([31 ** len(x) for x in names], np.int64), np.array([_raw_hash(x) for x in names], np.int64)


def _hashed(texts: list[str | None], dimension: int) -> np.ndarray:
    texts = [t or "" for t in texts]
    out = _tapped(texts, dimension)
    codes, _, ends = _spans([t.lower() + "\n" for t in texts])  # a word ends with its text
    blank = np.ones(len(codes) + 1, bool)
    blank[1:] = (codes < len(_BLANK)) & _BLANK[np.minimum(codes, len(_BLANK) - 1)]
    edges = np.diff(blank.astype(np.int8))
    first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    at = np.searchsorted(ends, first, "right") * dimension + _signed(_raw_hashes(codes, first, last)) % dimension
    return _unit(out + np.bincount(at, (last - first) * 0.3, out.size).reshape(out.shape))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in blocks of bounded size, each with where it starts; a longer text is a block of its own."""
    for at in range(0, len(texts), BLOCK_ROWS):
        held, start, size = texts.slice(at, BLOCK_ROWS).to_pylist(), 0, 0
        for i, t in enumerate(held):
            if i > start and size + len(t or "") > BLOCK_CHARS:
                yield at + start, held[start:i]
                start, size = i, 0
            size += len(t or "")
        yield at + start, held[start:]


def _vectors(texts: pa.Array, fn: Callable, dimension: int) -> pa.Array:
    """Vectors as one block of numbers, not as lists of objects."""
    numbers = np.empty((len(texts), dimension))
    for at, block in _blocks(texts):
        numbers[at : at + len(block)] = fn(block, dimension)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, numbers.size + 1, dimension, dtype=np.int32)), pa.array(numbers.reshape(-1)))


def _vector_udf(fn, dimension: int):
    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return _vectors(texts, fn, dimension)

    return embed


def with_vectors(rows: DataFrame, text: str, embedder: str, name: str = "embedding", keep_text: bool = False) -> DataFrame:
    """``rows`` with the vectors of their texts in the place of these, or beside them, block by block: a task holds no more than one block's vectors, however large Spark's batches are."""
    fn, dimension = BLOCKWISE[embedder]
    at_text = rows.columns.index(text)
    kept = [i for i, c in enumerate(rows.columns) if keep_text or c != text]
    names = [*(rows.columns[i] for i in kept), name]
    schema = T.StructType([T.StructField(rows.columns[i], rows.schema.fields[i].dataType) for i in kept] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BLOCK_ROWS):
                batch = big.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), _vectors(batch.column(at_text), fn, dimension)], names=names)

    return rows.mapInArrow(run, schema)


def plain_embedding(text, dimension: int = 384) -> Column:
    """Each character adds ``code / 128`` at ``code % dimension``."""
    return _vector_udf(_plain, dimension)(col(text))


def character_embedding(text, dimension: int = 1024) -> Column:
    """Each character adds ``0.1 * code`` at ``code % dimension``; unit length, zeros stay zeros."""
    return _vector_udf(_character, dimension)(col(text))


def fallback_vector(text: str | None, dimension: int = 1024) -> np.ndarray:
    return _fallback([text], dimension)[0]


def fallback_embedding(text) -> Column:
    """Three taps for each character of the trimmed lower-case text and a small hash term; 1024 numbers."""
    return _vector_udf(_fallback, 1024)(col(text))


def hashed_vector(text: str | None, dimension: int = 384) -> np.ndarray:
    return _hashed([text], dimension)[0]


def hashed_embedding(text) -> Column:
    """Three taps for each character and one for each word; 384 numbers."""
    return _vector_udf(_hashed, 384)(col(text))


EMBEDDERS = {
    "fallback": fallback_embedding,
    "hashed": hashed_embedding,
    "character": character_embedding,
    "plain": plain_embedding,
}
#: What makes them of a block of texts, and how many numbers a vector has.
BLOCKWISE = {"fallback": (_fallback, 1024), "hashed": (_hashed, 384), "character": (_character, 1024), "plain": (_plain, 384)}

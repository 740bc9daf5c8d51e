"""Packing by lexical retrieval: windows of documents that share rare terms.

Each text is tokenized once. Document frequencies and the mean length are those of the whole table. Terms in two documents
or more have one global order: first those in at most as many documents as a shard holds, most frequent first, then the others,
rarest first. A document's place is its first ``LEADS`` terms in that order, so documents that share them are neighbours, and
a range of places is a shard of about ``SHARD_CHARS`` characters: a term with more documents is split by the next terms, and
documents alike in all of them by hash, so a source or group of copies of any size is many tasks. Documents that share
rare terms but none of their leading ones can still be dealt apart.

Each shard builds a BM25 inverted index over its documents' tokens. A window starts
with what the last one cut off, or with the next unused document; this seed's best terms query the
index, and unused neighbours, best first, fill the window greedily. A document that doesn't fit is
cut, and its rest seeds the next window, so only the last window of a shard needs padding: about
one window for ``SHARD_CHARS`` characters, well under one percent.

Tokens are those of the tokenizer file for the whole text without special tokens, then the end id.
The tokenizer never merges across ASCII blanks, so each blank-separated word is encoded once and
kept in a bounded cache under a 64-bit hash; tests hold this against encoding whole texts.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own;
a null ``doc_id`` is packed like any other; a text longer than a window spans windows; only
``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices, table

WINDOW = 2_048
END_ID = 1
SHARD_CHARS = 1_000_000
LEADS = 6
#: Sampled documents for each range of places.
PER_RANGE = 50
QUERY_TERMS = 16
K1, B = 1.2, 0.75
SEED = 90_001
CACHED_WORDS = 700_000


#: Byte-level tokenizers write a byte that has no visible Latin-1 character as one from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SEEN)}

#: By byte: ASCII blanks; small ASCII letters; the second byte of a Latin-1 letter after 0xC3; ASCII marks and digits.
_BLANK = np.array([b in b" \t\n\r\v\f" for b in range(256)])
_SMALL = np.array([chr(b).isascii() and chr(b).islower() for b in range(256)])
_AFTER_C3 = np.array([0x80 <= b < 0xC0 and chr(b + 0x40).isalpha() for b in range(256)])
_MARK = np.array([0x20 < b < 0x7F and not chr(b).isalpha() for b in range(256)])

#: Words above this many bytes are encoded each time, shorter ones are kept.
KEPT_BYTES = 64
_BLOCK = 1 << 20
_random = np.random.default_rng(64)
_BYTE_HASH = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_random.integers(0, 2**62)) * 4 + 3
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, as many as a block has bytes."""
    if base not in _powers:
        factors = np.full(_BLOCK + KEPT_BYTES + 1, np.uint64(base % 2**64))
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of at most ``KEPT_BYTES`` bytes at these places, which rise."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers_of(_BASE), _powers_of(pow(_BASE, -1, 2**64))
    for block in range(0, len(data), _BLOCK):
        i, j = np.searchsorted(starts, (block, block + _BLOCK))
        if i < j:
            base = starts[i]
            part = _BYTE_HASH[data[base : ends[j - 1]]]
            sums = np.append(np.uint64(0), np.cumsum(part * up[: len(part)]))
            at = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[at]) * down[at]
    return out


def _letters(word: bytes) -> bool:
    """Whether a word is made of small letters alone, composed as they should be."""
    if word.isalpha():
        return word.islower()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where a mark or digit follows a letter, in bytes of UTF-8: tokenizers that keep letters apart cut there."""
    letter = _SMALL[data]
    letter[1:] |= (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    return np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1


class _Known:
    """Words by their hashes, and the ids of each in one array: about 40 bytes a word."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.used = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), 0

    def which(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the words with these sorted hashes; -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        base, more = len(self.keys), len(ids)
        self.starts = _room(self.starts, base + len(keys) + 1)
        self.flat = _room(self.flat, self.used + more)
        self.starts[base + 1 : base + len(keys) + 1] = self.used + np.cumsum(lengths)
        self.flat[self.used : self.used + more] = ids
        self.used += more
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.numbers = np.insert(self.numbers, at, np.arange(base, base + len(keys)))

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these words are in ``flat``, end to end, and how many each has."""
        begin = self.starts[which]
        lengths = self.starts[which + 1] - begin
        return _runs(begin, lengths), lengths


def _runs(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``begin[i] ... begin[i] + lengths[i] - 1`` for each ``i``, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Token ids of texts, through a cache of words; for tokenizers that split at ASCII blanks.

    If the tokenizer also leaves words of letters to its model as they are, and cuts them from a
    mark that follows, which is tried out first, such words go to the model directly and marks are words of their own.
    When the cache is full it becomes the older one, and a word found there isn't learnt again.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached_words = Tokenizer.from_file(path), cached_words
        tried = ["a", "the", "window", "retrieval", "zzxqjvk", "antidisestablishmentarianism", "été", "über", "año", "дом", "中文"]
        marks = [chr(b) for b in np.flatnonzero(_MARK)]
        tails = [*marks, *(m + m for m in marks), *(m + "." for m in marks), "'s", "'ll", "-a", "3b", "...c"]
        alone = {t: self._ids(t) for t in [*tried, *tails]}
        self.lowers = all(self._ids(w.upper()) == alone[w] for w in tried)
        self.simple = self.lowers and all(self._model_ids(w) == alone[w] for w in tried) and all(
            self._ids(w + t) == alone[w] + alone[t] for w in tried[:9] for t in tails
        )
        self.known, self.older = _Known(), _Known()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model_ids(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [self.simple and _letters(w) for w in words]
        odd = [t for t, p in zip(texts, plain) if not p]
        encoded = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [])
        return [self._model_ids(t) if p else next(encoded).ids for t, p in zip(texts, plain)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of these unknown words under their hashes, which are sorted."""
        old = self.older.which(keys)
        seen = old >= 0
        if seen.any():
            at, lengths = self.older.places(old[seen])
            self.known.add(keys[seen], self.older.flat[at], lengths)
        new = np.flatnonzero(~seen)
        ids = self._encoded([words[i] for i in new.tolist()])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.add(keys[new], np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        # what may hold a special token is left to the tokenizer
        special = [i for i, x in enumerate(raw) if b"<|" in x]
        apart = {i: np.array(self._ids(texts[i]), np.uint32) for i in special}
        for i in special:
            raw[i] = b""
        # one blank after each text; lower-casing ASCII makes more words alike
        data = b"".join(x + b"\n" for x in raw)
        data = data.lower() if self.lowers else data
        ends = np.cumsum([len(x) + 1 for x in raw])
        if self.simple and len(data) > 1:
            places = mark_places(np.frombuffer(data, np.uint8))
            data = np.insert(np.frombuffer(data, np.uint8), places, 0x20).tobytes()
            ends = ends + np.searchsorted(places, ends)
        ids, word_starts, id_ends = self._words(data)
        first = np.append(0, id_ends)[np.searchsorted(word_starts, np.append(0, ends))]
        return [apart[i] if i in apart else ids[a:b] for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist()))]

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words end to end, where each word starts, and where its ids end."""
        array = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[array], [True])))) if len(array) else np.zeros(0, np.int64)
        starts, ends = edges[::2], edges[1::2]
        if len(self.known.keys) > self.cached_words:
            self.known, self.older = _Known(), self.known
        short = np.flatnonzero(ends - starts <= KEPT_BYTES)
        keys, at, back = np.unique(word_hashes(array, starts[short], ends[short]), return_index=True, return_inverse=True)
        which = self.known.which(keys)
        new = np.flatnonzero(which < 0)
        if len(new):
            a, b = starts[short[at[new]]].tolist(), ends[short[at[new]]].tolist()
            self._learn(keys[new], [data[i:j] for i, j in zip(a, b)])
            which[new] = self.known.which(keys[new])
        lengths = np.zeros(len(starts), np.int64)
        places, lengths[short] = self.known.places(which[back])
        long = np.flatnonzero(ends - starts > KEPT_BYTES).tolist()
        encoded = self._encoded([data[starts[i] : ends[i]] for i in long])
        lengths[long] = [len(x) for x in encoded]
        id_ends = np.cumsum(lengths)
        if not long:
            return self.known.flat[places], starts, id_ends
        ids = np.empty(id_ends[-1], np.uint32)
        ids[_runs((id_ends - lengths)[short], lengths[short])] = self.known.flat[places]
        for i, x in zip(long, encoded):
            ids[id_ends[i] - len(x) : id_ends[i]] = x
        return ids, starts, id_ends

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, sorted, and how often each occurs."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.diff(np.append(first, len(ids)))


class Bm25:
    """Inverted index over documents given as arrays of term ids: postings by term, with BM25 weights.

    ``corpus``: number of documents, mean length and document frequency by term of the whole corpus, else those of ``docs``."""

    def __init__(self, docs: list[np.ndarray], corpus: tuple[int, float, np.ndarray] | None = None):
        found = [counted(d) for d in docs]
        self.n = len(docs)
        sizes = np.array([len(t) for t, _ in found], np.int64)
        term = np.concatenate([t for t, _ in found]) if docs else np.zeros(0, np.uint32)
        tf = np.concatenate([c for _, c in found]).astype(np.float32) if docs else np.zeros(0, np.float32)
        doc = np.repeat(np.arange(self.n), sizes)
        length = np.array([len(d) for d in docs], np.float32)
        total, mean = corpus[:2] if corpus else (self.n, float(length.mean()) if self.n else 1.0)
        scale = K1 * (1 - B + B * length / max(1.0, mean))
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.terms, df = counted(term[order])
        self.first = np.append(0, np.cumsum(df))
        spread = corpus[2][self.terms] if corpus else df
        idf = np.log1p((total - spread + 0.5) / (spread + 0.5)).astype(np.float32)
        weight = tf * (K1 + 1) / (tf + scale[doc])
        self.weight = weight[order] * np.repeat(idf, df)
        # each document's best terms that others have too
        place = np.zeros(int(self.terms[-1]) + 1 if len(df) else 0, np.int64)
        place[self.terms] = np.arange(len(df))
        at = place[term]
        worth = np.where(df[at] > 1, weight * idf[at], 0)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.queries = []
        for a, b in zip(bounds, bounds[1:]):
            best = a + np.argsort(-worth[a:b], kind="stable")[:QUERY_TERMS]
            self.queries.append(at[best[worth[best] > 0]])

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with ``doc``, best first, ties by position."""
        scores = np.zeros(self.n, np.float32)
        for t in self.queries[doc]:
            a, b = self.first[t], self.first[t + 1]
            scores[self.doc[a:b]] += self.weight[a:b]
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")]


def order_by_retrieval(docs: list[np.ndarray], window: int, corpus: tuple[int, float, np.ndarray] | None = None) -> list[int]:
    """The order in which documents fill windows one after the other."""
    index, unused, order = Bm25(docs, corpus), np.ones(len(docs), bool), []
    at = following = 0  # tokens laid so far, next document to look at
    while len(order) < len(docs):
        if at % window == 0 or not order:
            while not unused[following]:
                following += 1
            seed = following
            order.append(seed)
            unused[seed] = False
            at += len(docs[seed])
        else:
            seed = order[-1]
        room = -at % window
        if not room:
            continue
        for d in index.neighbours(seed, unused):
            order.append(int(d))
            unused[d] = False
            at += len(docs[d])
            room -= len(docs[d])
            if room <= 0:
                break
        if room > 0 and len(order) < len(docs):  # nothing alike is left: the next document seeds the rest
            while not unused[following]:
                following += 1
            order.append(following)
            unused[following] = False
            at += len(docs[following])
    return order


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_tokenizers: dict[str, WordTokenizer] = {}


def _tokens(batches, path: str, end_id: int, kind: str):
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    tokenizer, end = _tokenizers[path], np.array([end_id], kind).tobytes()
    row = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "text"):
        docs = [x.astype(kind).tobytes() + end for x in tokenizer.encode_all(batch.column("text").to_pylist())]
        rows = pa.array(np.arange(row, row + len(docs)))
        row += len(docs)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("turn"), batch.column("chars"), rows, pa.array(docs, pa.binary())],
            names=["doc_id", "turn", "chars", "row", "tokens"],
        )


def _spread(batches, kind: str):
    """For each term the number of this partition's documents that have it."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("tokens").to_pylist():
            terms, _ = counted(np.frombuffer(raw, kind))
            counts = _room(counts, int(terms[-1]) + 1)
            counts[terms] += 1
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["term", "docs"])


def places(spread: np.ndarray, many: int) -> np.ndarray:
    """The rank of each term in the global order, from 0; terms of fewer than two documents come after all others."""
    order = np.lexsort((np.where(spread <= many, -spread, spread), spread > many, spread < 2))
    rank = np.empty(len(spread), np.int32)
    rank[order] = np.arange(len(spread), dtype=np.int32)
    rank[spread < 2] = len(spread)
    return rank


def leading(terms: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ranks of a document's first ``LEADS`` terms."""
    ranks, _ = counted(rank[terms])
    return np.append(ranks[:LEADS], np.full(max(0, LEADS - len(ranks)), len(rank), np.int32))


def _placed(batches, ranks, kind: str, cuts: list[tuple] | None = None):
    """Rows with their ``place``, and with ``cuts`` the number of the range it is in; without, places alone."""
    rank = ranks.value
    for big in batches:
        for at in range(0, big.num_rows, 1024):
            batch = big.slice(at, 1024)
            # big-endian, so that bytes are in the order of the ranks
            keys = [leading(np.frombuffer(raw, kind), rank).astype(">u4").tobytes() for raw in batch.column("tokens").to_pylist()]
            places = pa.array(keys, pa.binary())
            if cuts is None:
                yield pa.RecordBatch.from_arrays([places, batch.column("turn"), batch.column("row")], names=["place", "turn", "row"])
                continue
            whole = zip(keys, batch.column("turn").to_pylist(), batch.column("row").to_pylist())
            parts = pa.array([bisect_right(cuts, x) for x in whole], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, places, parts], names=[*batch.schema.names, "place", "part"])


def _shards(batches, shard_chars: int):
    """Tables of rows in the order given, each of about ``shard_chars`` characters."""
    held, chars, cut = [], 0, shard_chars + shard_chars // 2
    for batch in batches:
        sizes, start = batch.column("chars").to_numpy(), 0
        for i in range(batch.num_rows):
            if chars + sizes[i] > cut and chars:
                held.append(batch.slice(start, i - start))
                rows = pa.Table.from_batches(held)
                ends = np.cumsum(rows.column("chars").to_numpy())
                n = max(1, int(np.searchsorted(ends, shard_chars, "right")))
                yield rows.slice(0, n)
                rest = rows.slice(n)
                held, chars, start = rest.to_batches(), int(ends[-1] - ends[n - 1]), i
            chars += int(sizes[i])
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _pack(batches, window: int, shard_chars: int, corpus, kind: str):
    part = TaskContext.get().partitionId()
    for nth, group in enumerate(_shards(batches, shard_chars)):
        shard = (part << 12) + nth
        ids = group.column("doc_id").to_pylist()
        turn = group.column("turn").to_numpy()
        docs = [np.frombuffer(raw, kind) for raw in group.column("tokens").to_pylist()]
        by_turn = sorted(range(len(docs)), key=lambda i: (turn[i], len(docs[i]), ids[i] is None, ids[i] or 0))
        docs, ids = [docs[i] for i in by_turn], [ids[i] for i in by_turn]
        out, at = [], 0
        for d in order_by_retrieval(docs, window, corpus.value):
            start, size, wide = 0, len(docs[d]), docs[d].astype("<u4")
            while start < size:
                length = min(size - start, window - at % window)
                crc = zlib.crc32(wide[start : start + length])
                out.append((ids[d], start, length, crc, size, (shard << 32) + at // window, at % window))
                start, at = start + length, at + length
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], group.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def _vocabulary(batches, path: str):
    from tokenizers import Tokenizer

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"size": [Tokenizer.from_file(path).get_vocab_size()] * batch.num_rows})


def pack(docs: DataFrame, tokenizer: str, window=WINDOW, end_id=END_ID, shard_chars=SHARD_CHARS, seed=SEED) -> DataFrame:
    """Pieces of all ``docs``: ``doc_id`` and ``PIECES``. ``tokenizer`` is the path of a tokenizer file."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    size = arrow_map(spark.range(1, numPartitions=1), _vocabulary, "size long", path=tokenizer).first()["size"]
    kind = "<u2" if max(size, end_id + 1) <= 2**16 else "<u4"
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", F.length("text")).alias("turn"), chars.alias("chars"), "text")
    columns = f"doc_id {id_type}, turn long, chars long, row long, tokens binary"
    tokens = materialize(arrow_map(rows, _tokens, columns, path=tokenizer, end_id=end_id, kind=kind), "tokens")
    n, chars, length = tokens.agg(F.count("*"), F.sum("chars"), F.avg(F.length("tokens"))).first()
    shards = max(1, -(-(chars or 0) // shard_chars))
    # one number for each term of the tokenizer
    found = arrow_map(tokens.select("tokens"), _spread, "term long, docs long", kind=kind).groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    spread = np.zeros(max((r["term"] for r in found), default=0) + 1, np.int64)
    for r in found:
        spread[r["term"]] = r["docs"]
    ranks = spark.sparkContext.broadcast(places(spread, -(-n // shards)))
    corpus = spark.sparkContext.broadcast((n, (length or 4.0) / np.dtype(kind).itemsize, spread))
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 64)))
    # cuts between ranges, from a sample whose size goes with their number
    draw = F.pmod(F.xxhash64("turn", "row"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, parts * PER_RANGE / max(1, n))))
    drawn = arrow_map(tokens.where(draw), _placed, "place binary, turn long, row long", ranks=ranks, kind=kind)
    seen = sorted((bytes(r["place"]), r["turn"], r["row"]) for r in drawn.limit(4 * parts * PER_RANGE).collect())
    cuts = sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else []
    placed = arrow_map(tokens, _placed, f"{columns}, place binary, part int", ranks=ranks, kind=kind, cuts=cuts)
    dealt = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "turn", "row").drop("place", "part", "row")
    return arrow_map(dealt, _pack, f"doc_id {id_type}, {PIECES}", window=window, shard_chars=shard_chars, corpus=corpus, kind=kind)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}

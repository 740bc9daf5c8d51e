"""Functions for SQL: chunkers as table functions to join by LATERAL, and scores, defined in SQL, so plans stay within the engine.

``register(spark)`` defines them for a session:

* ``pack_chunks(text, size)``: ``chunk_index``, ``content``: words packed greedily into chunks of at most ``size`` characters;
* ``window_chunks(text, size, overlap)``: windows of ``size`` characters that share ``overlap``;
* ``paragraph_chunks(text, size, overlap)``: paragraphs joined up to ``size`` characters, led by the last sentences of the chunk before;
* ``text_paragraphs(text)``: ``paragraph_index``, ``content``;
* ``vector_cosine(a, b)``: cosine similarity, 0 for vectors of other lengths or without a direction.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_CHUNK = "RETURNS TABLE(chunk_index INT, content STRING)"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\\s+|\\s+$', '')"


def _paragraphs(x: str) -> str:
    return rf"filter(transform(split({x}, '\\n\\s*\\n'), p -> {_trim('p')}), p -> p <> '')"


def _tail(chunk: str) -> str:
    """The last sentences of a chunk, each with its full stop, until they reach the wanted length."""
    sentences = rf"reverse(filter(transform(split({chunk}, '[.!?]+'), t -> {_trim('t')}), t -> t <> ''))"
    return _trim(f"aggregate({sentences}, '', (held, t) -> if(length(held) >= least(paragraph_chunks.overlap, length({chunk}) / 2), held, concat(t, '. ', held)))")


_FULL = "length(s.cur) + length(p) > paragraph_chunks.size AND s.cur <> ''"
FUNCTIONS = {
    "pack_chunks": rf"""(text STRING, size INT) {_CHUNK} RETURN
 SELECT pos, chunk FROM (SELECT posexplode(regexp_extract_all({_trim(r"regexp_replace(pack_chunks.text, '\\s+', ' ')")},
  concat('(?s)[^ ].{{0,', greatest(pack_chunks.size, 1) - 1, '}}(?<=[^ ])(?= |\\z)|[^ ]+'), 0)) AS (pos, chunk))""",
    "window_chunks": f"""(text STRING, size INT, overlap INT) {_CHUNK} RETURN
 SELECT pos, substring(window_chunks.text, at, window_chunks.size) FROM (SELECT posexplode(if(length(window_chunks.text) > 0, sequence(1,
  greatest(1, cast(ceil((length(window_chunks.text) - window_chunks.overlap) / (window_chunks.size - window_chunks.overlap)) AS INT) * (window_chunks.size - window_chunks.overlap)
   - (window_chunks.size - window_chunks.overlap) + 1), window_chunks.size - window_chunks.overlap), array())) AS (pos, at))""",
    "paragraph_chunks": f"""(text STRING, size INT, overlap INT) {_CHUNK} RETURN
 SELECT pos, {_trim('chunk')} FROM (SELECT posexplode(aggregate({_paragraphs('paragraph_chunks.text')}, named_struct('done', cast(array() AS ARRAY<STRING>), 'cur', ''),
  (s, p) -> if({_FULL}, named_struct('done', concat(s.done, array(s.cur)), 'cur', concat({_tail('s.cur')}, p)),
   named_struct('done', s.done, 'cur', if(s.cur = '', p, concat(s.cur, '\\n\\n', p)))),
  s -> if({_trim('s.cur')} <> '', concat(s.done, array(s.cur)), s.done))) AS (pos, chunk))""",
    "text_paragraphs": f"""(text STRING) RETURNS TABLE(paragraph_index INT, content STRING) RETURN
 SELECT pos, p FROM (SELECT posexplode({_paragraphs('text_paragraphs.text')}) AS (pos, p))""",
    "vector_cosine": """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
 CASE WHEN size(a) <> size(b) THEN 0D ELSE coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
  / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D) END""",
}


def register(spark: SparkSession) -> None:
    """Define the functions for this session; doing it again changes nothing."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

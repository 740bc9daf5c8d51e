"""Chunking, questions, answers, quality and formats over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import embedding as V
from lectern.functions import text as T
from lectern.operators import chunking as C
from lectern.operators import search as S

from .tables import chunks, table, trim_sql, vector_queries

SIZE = 600


def _paragraphs():
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def _pages():
    """The text in two marked pages, cut in the middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    return F.concat(F.lit("--- Page 1 ---\n"), first, F.lit("\n\n--- Page 2 ---\n"), second)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pieces(spark, sf_dir, chunked, text=None):
    d = _docs(spark, sf_dir)
    d = d.withColumn("text", text) if text is not None else d
    return C.exploded(d, chunked, "doc_id")


def chunk_pack(spark, sf_dir):
    """Words packed into chunks of 600 characters."""
    return _pieces(spark, sf_dir, C.pack_words("text", SIZE))


def chunk_overlap(spark, sf_dir):
    """Page-marked texts in chunks, each led by the one before it."""
    return _pieces(spark, sf_dir, C.chunk_pages("text", SIZE, 100), _pages())


def chunk_adaptive(spark, sf_dir):
    """Chunk size and overlap by text length."""
    size = C.adaptive_size("text")
    return _docs(spark, sf_dir).select("doc_id", size["size"].alias("size"), size["overlap"].alias("overlap"))


def chunk_fixed(spark, sf_dir):
    """Windows of 500 characters that share 50."""
    return _pieces(spark, sf_dir, C.chunk_windows("text", 500, 50))


def chunk_paragraph(spark, sf_dir):
    """Paragraphs joined up to 1000 characters with sentence overlap."""
    return _pieces(spark, sf_dir, C.chunk_paragraphs("text", 1000, 150), _paragraphs())


def chunk_type(spark, sf_dir):
    """Type, confidence and word count of each packed chunk."""
    found = chunk_pack(spark, sf_dir)
    return found.select(
        "doc_id", "chunk_index", C.chunk_type("content").alias("type"), C.chunk_confidence("content").alias("confidence"),
        F.size(T.words("content")).alias("word_count"),
    )


def chunk_records(spark, sf_dir):
    """Paragraph chunks with the reference offset that all of a text's chunks carry."""
    d = _docs(spark, sf_dir).select("doc_id", _paragraphs().alias("text"))
    rows = C.chunk_rows(d, C.chunk_paragraphs("text", 1000, 150))
    return rows.select("doc_id", "chunk_index", "start_char_ref", "end_char_ref", "word_count", "type", "confidence")


def _user_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'")


def question_type(spark, sf_dir):
    """Type of each question and how many chunks it asks for."""
    kind = T.question_type("text")
    return _user_turns(spark, sf_dir).select("conv_id", "turn", kind.alias("kind")).withColumn("chunk_limit", T.chunk_limit("kind"))


def complexity(spark, sf_dir):
    """Complexity of each question with its token budgets out of 4000."""
    rows = _user_turns(spark, sf_dir).select("conv_id", "turn", T.complexity("text").alias("level"))
    return rows.withColumn("b", T.token_allocation(F.lit(4000), "level")).select("conv_id", "turn", "level", "b.*")


def token_budget(spark, sf_dir):
    """Hits of several questions while their tokens fit 1680."""
    q = vector_queries(spark, sf_dir, {0: "a", 7: "b", 20: "c"})
    hits = S.search(q, chunks(spark, sf_dir), "semantic", "local", limit=20, threshold=0.05, ties=("chunk_id",))
    fitting = S.token_prefix(hits.withColumn("tokens", T.estimate_tokens("content")), 1680)
    return fitting.select("query_id", "rank", "chunk_id", "tokens", "tokens_so_far")


def relevance_score(spark, sf_dir):
    """Mean similarity of the hits of each question."""
    q = vector_queries(spark, sf_dir, {0: "a", 7: "b", 20: "c"})
    hits = S.search(q, chunks(spark, sf_dir), "semantic", "local", limit=5, threshold=0.05, ties=("chunk_id",))
    return hits.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("relevance"))


def quality_metrics(spark, sf_dir):
    """Quality of each document's text taken as an answer from three chunks."""
    q = T.quality_metrics("text", F.lit(3), F.lit(0.5), F.size(T.critique_flags("text")))
    return _docs(spark, sf_dir).select("doc_id", q.alias("q")).select("doc_id", "q.*")


def critique_flags(spark, sf_dir):
    """What marks in a text would point out."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.critique_flags("text"), "; ").alias("flags"))


def clean_response(spark, sf_dir):
    """Documents in the guise of answers with noise, cleaned."""
    noisy = F.concat(F.lit("**Confidence: HIGH**\n\n\n\nRating: "), F.col("text"), F.lit("\nNote: written in haste\nend"))
    return _docs(spark, sf_dir).select("doc_id", T.clean_response(noisy).alias("answer"))


def think_strip(spark, sf_dir):
    """Assistant turns with a thinking part before them, without it."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", T.strip_thinking(F.concat(F.lit("<think>so\nso</think>\n"), "text")).alias("answer"))


def language_detect(spark, sf_dir):
    """Language of each document by frequent words."""
    return _docs(spark, sf_dir).select("doc_id", T.detect_language("text").alias("language"), T.detect_english("text").alias("english"))


def text_confidence(spark, sf_dir):
    """Confidence and extraction quality of each text as one page."""
    rows = _docs(spark, sf_dir).select("doc_id", "text", T.text_confidence("text").alias("confidence"))
    q = {p: T.extraction_quality(F.lit(1), F.lit(1), F.length("text"), F.col("confidence"), p) for p in T.QUALITY_BOUNDS}
    return rows.select("doc_id", "confidence", *[c.alias(p) for p, c in q.items()])


def formats(spark, sf_dir):
    """Sizes, times and bands as text."""
    d = _docs(spark, sf_dir)
    return d.select(
        "doc_id", T.file_size(F.col("n_chars") * 700).alias("size"), T.uptime("n_chars").alias("uptime"),
        T.score_band(F.col("n_chars") / 3000).alias("band"), T.quality_notice(F.col("n_chars") / 40).alias("notice"),
        F.array_join(T.parse_list(F.concat("lang", F.lit(", , "), "source")), "|").alias("parsed"),
    )


def hash_value(spark, sf_dir):
    """The 32-bit hash of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select("item_id", V.simple_hash("text").alias("hash"))


def embed_plain(spark, sf_dir):
    """The plain character embedding of each passage, by dimension."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.plain_embedding("text")).alias("dim", "v"))
    return rows.where("v <> 0").select("item_id", "dim", F.round("v", 6).alias("v"))


def embed_character(spark, sf_dir):
    """The unit-length character embedding of each passage, by dimension."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.character_embedding("text")).alias("dim", "v"))
    return rows.where("v <> 0").select("item_id", "dim", F.round("v", 6).alias("v"))


def embed_fallback(spark, sf_dir):
    """The three-tap embedding of each document: its length is 1 and its largest component this one."""
    rows = V.with_vectors(_docs(spark, sf_dir).select("doc_id", "text"), "text", "fallback", "v")
    return rows.select("doc_id", F.size("v").alias("dims"), F.round(F.array_max("v"), 6).alias("largest"))


def embed_hashed(spark, sf_dir):
    """The word-hash embedding of each document."""
    rows = V.with_vectors(_docs(spark, sf_dir).select("doc_id", "text"), "text", "hashed", "v")
    return rows.select("doc_id", F.size("v").alias("dims"), F.round(F.array_max("v"), 6).alias("largest"))


_PACK = rf"""
SELECT doc_id, list_reduce(list_prepend(NULL, list_transform(ws, lambda w: {{'out': []::VARCHAR[], 'cur': w}})), lambda s, x:
  CASE WHEN s IS NULL THEN x WHEN length(s.cur) + length(x.cur) + 1 > {SIZE} THEN {{'out': list_append(s.out, s.cur), 'cur': x.cur}}
  ELSE {{'out': s.out, 'cur': s.cur || ' ' || x.cur}} END) AS s FROM
  (SELECT doc_id, list_filter(regexp_split_to_array({trim_sql('t')}, '\s+'), lambda w: w <> '') AS ws FROM %s) WHERE len(ws) > 0"""
_PACKED = "SELECT doc_id, list_append(s.out, s.cur) AS c FROM (" + _PACK + ")"
_ROWS = "SELECT doc_id, unnest(c) AS content, unnest(range(len(c)))::INTEGER AS chunk_index FROM ({})"
_PACK_ROWS = _ROWS.format(_PACKED % "(SELECT doc_id, text AS t FROM documents)")
_TYPE = rf"""CASE WHEN length(content) < 50 AND regexp_matches({trim_sql('content')}, '^[A-Z][^.!?]*$') THEN 'heading'
 WHEN contains(content, '•') OR contains(content, '-') OR regexp_matches(content, '^\d+\.') THEN 'list'
 WHEN contains(content, '|') OR contains(content, chr(9)) THEN 'table'
 WHEN length(content) > 50 AND contains(content, '.') THEN 'paragraph' ELSE 'other' END"""
_SURE = r"""least(100, 50 + CASE WHEN length(content) > 100 THEN 20 ELSE 0 END + CASE WHEN contains(content, '.') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(content, '[A-Z]') THEN 10 ELSE 0 END + CASE WHEN len(regexp_split_to_array(content, '\s+')) > 10 THEN 10 ELSE 0 END)"""


_OVERLAP = rf"""{trim_sql("""list_reduce(list_prepend('', list_reverse(list_filter(list_transform(regexp_split_to_array(s.cur, '[.!?]+'),
 lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> ''))), lambda h, z: CASE WHEN length(h) >= least(150, length(s.cur) / 2) THEN h ELSE z || '. ' || h END)""")}"""
_PARAGRAPHS = rf"""
SELECT doc_id, list_transform(list_append(s.out, s.cur), lambda z: {trim_sql('z')}) AS c FROM (
 SELECT doc_id, list_reduce(list_prepend(NULL, list_transform(ps, lambda p: {{'out': []::VARCHAR[], 'cur': p}})), lambda s, x:
  CASE WHEN s IS NULL THEN x WHEN length(s.cur) + length(x.cur) > 1000 THEN {{'out': list_append(s.out, s.cur), 'cur': {_OVERLAP} || x.cur}}
  ELSE {{'out': s.out, 'cur': s.cur || chr(10) || chr(10) || x.cur}} END) AS s FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda z: {trim_sql('z')}),
   lambda z: z <> '') AS ps FROM documents) WHERE len(ps) > 0)"""
_PARAGRAPH_ROWS = _ROWS.format(_PARAGRAPHS)


def _counts_sql(words):
    return " + ".join(rf"len(regexp_extract_all(s, '\b{w}\b'))" for w in words)


_LANG_COUNTS = ", ".join(f"{_counts_sql(ws)} AS {name}" for name, ws in T.LANGUAGE_WORDS.items())
_ENGLISH = " + ".join(f"len(string_split(e, '{w}')) - 1" for w in T.ENGLISH_PARTS)
_TOP = "greatest(English, Spanish, French, German)"
_HITS = """WITH c AS (SELECT e.vec_id AS chunk_id, e.embedding::DOUBLE[] AS v, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (0, 7, 20)
), p AS (SELECT query_id, chunk_id, text, list_cosine_similarity(v, qv) AS s FROM c, q
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM p WHERE s >= 0.05)"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)({p})') THEN '{k}'" for k, p in T.QUESTION_TYPES.items()) + " ELSE 'general' END"
_LIMIT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in T.CHUNK_LIMITS.items()) + " END"
_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{s}' END" for m, s in T.CRITIQUE_MARKS.items()) + "], lambda x: x IS NOT NULL)"
_HASH = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
 lambda h, c: ((31 * h + c + 2147483648) & 4294967295) - 2147483648)"""
_CHARS = "SELECT item_id, unicode(c) % {} AS dim, unicode(c) AS code FROM (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark)"

QUERIES = {
    f.__name__: f
    for f in (
        chunk_pack, chunk_overlap, chunk_adaptive, chunk_fixed, chunk_paragraph, chunk_type, chunk_records, question_type, complexity,
        token_budget, relevance_score, quality_metrics, critique_flags, clean_response, think_strip, language_detect,
        text_confidence, formats, hash_value, embed_plain, embed_character, embed_fallback, embed_hashed,
    )
}
ORACLES = {
    "chunk_pack": _PACK_ROWS,
    "chunk_paragraph": _PARAGRAPH_ROWS,
    "clean_response": rf"""SELECT doc_id, {trim_sql("regexp_replace('Rating: ' || text || chr(10) || chr(10) || 'end', '^Rating:', '')")} AS answer FROM documents""",
    "chunk_type": rf"SELECT doc_id, chunk_index, {_TYPE} AS type, {_SURE} AS confidence, len(regexp_split_to_array(content, '\s+')) AS word_count FROM ({_PACK_ROWS})",
    "chunk_overlap": f"""
WITH p AS (SELECT doc_id, 1 AS page, substr(text, 1, (length(text) // 2)::BIGINT) AS t FROM documents
 UNION ALL SELECT doc_id, 2, substr(text, (length(text) // 2)::BIGINT + 1) FROM documents
), k AS (SELECT doc_id * 2 + page AS doc_id, t FROM p WHERE {trim_sql('t')} <> ''
), c AS (SELECT (doc_id - 1) // 2 AS d, doc_id AS key, content, chunk_index AS i FROM ({_ROWS.format(_PACKED % 'k')})
), o AS (SELECT d AS doc_id, row_number() OVER w - 1 AS chunk_index, lag(content) OVER w AS before, content FROM c WINDOW w AS (PARTITION BY d ORDER BY key, i))
SELECT doc_id, chunk_index, CASE WHEN before IS NULL THEN content ELSE before || chr(10) || content END AS content FROM o""",
    "chunk_adaptive": """SELECT doc_id, s AS size, (s // 10)::INTEGER AS overlap FROM (SELECT doc_id,
 CASE WHEN length(text) > 20000 THEN 1000 WHEN length(text) > 10000 THEN 800 WHEN length(text) > 5000 THEN 600 ELSE 400 END AS s FROM documents)""",
    "chunk_fixed": """SELECT doc_id, i::INTEGER AS chunk_index, substr(text, i * 450 + 1, 500) AS content FROM (
 SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 50) / 450))::BIGINT)) AS i FROM documents WHERE length(text) > 0)""",
    "question_type": f"SELECT conv_id, turn, kind, {_LIMIT} AS chunk_limit FROM (SELECT conv_id, turn, {_KIND} AS kind FROM conversations WHERE role = 'user')",
    "complexity": f"""
SELECT conv_id, turn, level, CASE level WHEN 'simple' THEN 2400 WHEN 'normal' THEN 1600 ELSE 1200 END AS context,
 CASE level WHEN 'simple' THEN 0 WHEN 'normal' THEN 1200 ELSE 1600 END AS critique, CASE level WHEN 'simple' THEN 1600 ELSE 1200 END AS refinement,
 CASE level WHEN 'simple' THEN 1680.0 WHEN 'normal' THEN 1120.0 ELSE 840.0 END::DOUBLE AS prefix FROM (SELECT conv_id, turn,
 CASE WHEN regexp_matches(text, '(?i)({T.SIMPLE_WORDS})') AND length(text) < 50 THEN 'simple'
  WHEN regexp_matches(text, '(?i)({T.COMPLEX_WORDS})') OR length(text) > 150 OR length(text) - length(replace(text, '?', '')) > 1 THEN 'complex'
  ELSE 'normal' END AS level FROM conversations WHERE role = 'user')""",
    "token_budget": f"""{_HITS}, t AS (SELECT query_id, rank, chunk_id, ceil(length(text) / 4)::BIGINT AS tokens FROM r WHERE rank <= 20
), x AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS tokens_so_far FROM t) SELECT * FROM x WHERE tokens_so_far <= 1680""",
    "relevance_score": f"{_HITS} SELECT query_id, round(avg(s), 6) AS relevance FROM r WHERE rank <= 5 GROUP BY query_id",
    "quality_metrics": f"""SELECT *, (accuracy + completeness + clarity + confidence) / 4 AS rating FROM (SELECT doc_id,
 CASE WHEN (contains(text, '[') OR contains(text, 'Document') OR contains(text, 'Source')) AND len({_FLAGS}) = 0 THEN 90.0 ELSE 70.0 END::DOUBLE AS accuracy,
 85.0::DOUBLE AS completeness,
 CASE WHEN contains(text, chr(10) || chr(10)) OR contains(text, '##') OR contains(text, '1.') THEN 80.0 ELSE 60.0 END::DOUBLE AS clarity,
 50.0::DOUBLE AS confidence FROM documents)""",
    "critique_flags": f"SELECT doc_id, array_to_string({_FLAGS}, '; ') AS flags FROM documents",
    "think_strip": f"SELECT conv_id, turn, {trim_sql('text')} AS answer FROM conversations WHERE role = 'assistant'",
    "language_detect": f"""
WITH x AS (SELECT doc_id, text, lower(substr(text, 1, 2000)) AS s, lower(substr(text, 1, 1000)) AS e FROM documents
), n AS (SELECT doc_id, text, e, {_LANG_COUNTS} FROM x)
SELECT doc_id, CASE WHEN text = '' THEN 'en' WHEN {_TOP} <= 5 THEN 'Unknown' WHEN English = {_TOP} THEN 'English' WHEN Spanish = {_TOP} THEN 'Spanish'
 WHEN French = {_TOP} THEN 'French' ELSE 'German' END AS language, CASE WHEN {_ENGLISH} > 5 THEN 'English' ELSE 'Unknown' END AS english FROM n""",
    "text_confidence": r"""
WITH x AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, least(100, 50
 + CASE WHEN length(text) > 100 THEN 20 ELSE 0 END + CASE WHEN length(text) > 500 THEN 10 ELSE 0 END
 + CASE WHEN len(regexp_split_to_array(text, '\s+')) > 20 THEN 10 ELSE 0 END + CASE WHEN len(regexp_split_to_array(text, '\s+')) > 100 THEN 5 ELSE 0 END
 + CASE WHEN contains(text, chr(10) || chr(10)) THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?]') THEN 5 ELSE 0 END
 + CASE WHEN regexp_matches(text, '[A-Z][a-z]') THEN 5 ELSE 0 END - CASE WHEN length(text) < 50 THEN 20 ELSE 0 END
 - CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 0 ELSE 30 END)) END AS confidence FROM documents)
SELECT doc_id, confidence, CASE WHEN n > 800 AND confidence > 80 THEN 'high' WHEN n > 400 AND confidence > 60 THEN 'medium' ELSE 'low' END AS enhanced,
 CASE WHEN n > 500 THEN 'high' WHEN n > 200 THEN 'medium' ELSE 'low' END AS advanced FROM x""",
    "chunk_records": rf"""WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents
), f AS (SELECT doc_id, instr(text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda z: {trim_sql('z')}), lambda z: z <> '')[1]) - 1 AS begins FROM t)
SELECT doc_id, chunk_index, begins::INTEGER AS start_char_ref, (begins + length(content))::INTEGER AS end_char_ref,
 len(regexp_split_to_array(content, '\s+'))::INTEGER AS word_count, {_TYPE} AS type, {_SURE} AS confidence FROM ({_PARAGRAPH_ROWS}) JOIN f USING (doc_id)""",
    "formats": r"""SELECT doc_id, CASE WHEN n <= 0 THEN '0 Bytes' WHEN n < 1024 THEN n || ' Bytes'
 WHEN n < 1048576 THEN regexp_replace(printf('%.2f', round(n / 1024, 2)), '\.?0+$', '') || ' KB' ELSE regexp_replace(printf('%.2f', round(n / 1048576, 2)), '\.?0+$', '') || ' MB' END AS size,
 printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS uptime,
 CASE WHEN n_chars / 3000 >= 0.8 THEN 'green' WHEN n_chars / 3000 >= 0.6 THEN 'yellow' ELSE 'red' END AS band,
 CASE WHEN n_chars / 40 >= 85 THEN 'success' WHEN n_chars / 40 < 60 THEN 'warning' ELSE 'none' END AS notice,
 CASE WHEN lang IS NULL THEN NULL ELSE lang || '|' || source END AS parsed FROM (SELECT *, n_chars * 700 AS n FROM documents)""",
    "embed_hashed": f"""WITH t AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''
), n AS (SELECT doc_id, unicode(ch)::BIGINT AS c, count(*) AS n FROM t GROUP BY ALL
), taps AS (SELECT doc_id, c % 384 AS dim, 0.1::DOUBLE * c * n AS v FROM n UNION ALL SELECT doc_id, c * 3 % 384, 0.05::DOUBLE * c * n FROM n UNION ALL SELECT doc_id, c * 7 % 384, 0.02::DOUBLE * c * n FROM n
), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS text FROM documents
), k AS (SELECT text, abs({_HASH}) % 384 AS dim, length(text) * 0.3::DOUBLE AS v FROM (SELECT DISTINCT text FROM w)
), a AS (SELECT doc_id, dim, v FROM taps UNION ALL SELECT w.doc_id, k.dim, k.v FROM w JOIN k USING (text)
), s AS (SELECT doc_id, dim, sum(v) AS v FROM a GROUP BY ALL
), u AS (SELECT doc_id, max(v) / nullif(sqrt(sum(v * v)), 0) AS m FROM s GROUP BY doc_id)
SELECT d.doc_id, 384 AS dims, coalesce(round(m, 6), 0) AS largest FROM documents d LEFT JOIN u USING (doc_id)""",
    "embed_fallback": f"""WITH x AS (SELECT doc_id, CASE WHEN {trim_sql('text')} = '' THEN 'default text' ELSE text END AS text FROM documents
), t AS (SELECT doc_id, unnest(string_split({trim_sql('lower(text)')}, '')) AS ch FROM x
), n AS (SELECT doc_id, unicode(ch)::BIGINT AS c, count(*) AS n FROM t GROUP BY ALL
), h AS (SELECT doc_id, i AS dim, list_reduce(list_prepend(h, list_transform(string_split(i::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: ((31 * h + c + 2147483648) & 4294967295) - 2147483648) AS h FROM (SELECT doc_id, {_HASH} AS h, unnest(range(0, 1024, 10)) AS i FROM x)
), a AS (SELECT doc_id, c % 1024 AS dim, 0.1::DOUBLE * c * n AS v FROM n UNION ALL SELECT doc_id, c * 3 % 1024, 0.05::DOUBLE * c * n FROM n UNION ALL SELECT doc_id, c * 7 % 1024, 0.02::DOUBLE * c * n FROM n
  UNION ALL SELECT doc_id, dim, abs(h) % 100 * 0.001::DOUBLE FROM h
), s AS (SELECT doc_id, dim, sum(v) AS v FROM a GROUP BY ALL)
SELECT doc_id, 1024 AS dims, round(max(v) / sqrt(sum(v * v)), 6) AS largest FROM s GROUP BY doc_id""",
    "hash_value": f"SELECT item_id, abs({_HASH}) AS hash FROM benchmark",
    "embed_plain": f"SELECT item_id, dim, round(sum(code) / 128, 6) AS v FROM ({_CHARS.format(384)}) GROUP BY ALL",
    "embed_character": f"""WITH s AS (SELECT item_id, dim, sum(code) * 0.1::DOUBLE AS v FROM ({_CHARS.format(1024)}) GROUP BY ALL)
SELECT item_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS v FROM s""",
}

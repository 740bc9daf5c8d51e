"""Scalar text functions as column expressions.

``trim`` here strips all white space, as the search semantics need; ``length`` counts code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: What ``\s`` of a pattern stands for.
BLANKS = " \t\n\x0b\f\r"


def trim(x) -> Column:
    """Without white space at the ends; a pattern would look at every character between them."""
    return F.btrim(col(x), F.lit(BLANKS))


def single_blanks(x) -> Column:
    """White space as single blanks, without any at the ends; a pattern is asked only for texts that have blanks in a row."""
    x = reduce(lambda y, b: F.replace(y, F.lit(b), F.lit(" ")), BLANKS[1:], col(x))
    return let(F.trim(x), lambda y: F.when(F.contains(y, F.lit("  ")), F.regexp_replace(y, "  +", " ")).otherwise(y))


def first_match(cases, otherwise) -> Column:
    """The value of the first condition that holds, in order."""
    result = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def normalize(x) -> Column:
    """Lower case, punctuation to blanks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(x)), r"\W+", " "))


def words(x) -> Column:
    return F.split(col(x), r"\s+")


def estimate_tokens(x) -> Column:
    """About four characters to a token."""
    return F.ceil(F.length(col(x)) / 4).cast("long")


# -- keyword relevance -------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not wherever a lambda in the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _keyword_score(q: Column, c: Column) -> Column:
    asked, there, padded = q["words"], c["words"], F.concat(F.lit(" "), c["normal"], F.lit(" "))
    n = F.size(asked)
    missing = F.filter(asked, lambda w: ~F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
    return let(
        F.struct(
            n.alias("n"), (n - F.size(missing)).alias("exact"),
            # words have no blanks, so a word lies within a content word if it lies within the content
            F.size(F.filter(missing, lambda w: F.contains(c["normal"], w) | F.exists(there, lambda t: F.contains(w, t)))).alias("partly"),
            ((F.length(c["normal"]) - F.length(F.replace(c["normal"], q["normal"], F.lit("")))) / F.greatest(F.length(q["normal"]), F.lit(1))).alias("times"),
        ),
        _mixed_words,
    )


def _mixed_words(x: Column) -> Column:
    base = x["exact"] / F.greatest(x["n"], F.lit(1)) + 0.5 * x["partly"] / F.greatest(x["n"], F.lit(1))
    base = F.when((x["n"] == 1) & (x["exact"] > 0), F.least(F.lit(1.0), base * 2)).otherwise(base)
    bonus = F.when(x["exact"] > 0, F.least(F.lit(0.3), 0.1 * x["times"])).otherwise(0.0)
    return F.when(x["n"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base + bonus))


def keyword_form(text, query: bool = False) -> Column:
    """What keyword scores need of a text: its normal form and that form's words, a query's without empty ones."""
    ws = lambda n: F.filter(F.split(n, " "), lambda w: w != "") if query else F.split(n, " ")
    return let(normalize(text), lambda n: F.struct(n.alias("normal"), ws(n).alias("words"), (F.coalesce(F.length(col(text)), F.lit(0)) == 0).alias("empty")))


def keyword_score_of(query, content, empty_is_zero: bool = False) -> Column:
    """``keyword_score`` of two keyword forms, for texts that meet many others."""
    q, c = col(query), col(content)
    score = _keyword_score(q, c)
    return F.when(q["empty"] | c["empty"], F.lit(0.0)).otherwise(score) if empty_is_zero else score


def keyword_score(query, content, empty_is_zero: bool = False) -> Column:
    """Share of query words found in the content, in 0..1.

    Exact words count fully, words that contain or are contained in a content word count half, a
    single exact word counts double, and each occurrence of the whole query adds 0.1 up to 0.3.
    With ``empty_is_zero`` an empty query or content scores 0.
    """
    forms = F.struct(keyword_form(query, True).alias("q"), keyword_form(content).alias("c"))
    return let(forms, lambda x: keyword_score_of(x["q"], x["c"], empty_is_zero))


# -- questions and answers -------------------------------------------------------------------------

# Question types by words they contain, in order, and how many chunks each asks for.
QUESTION_TYPES = {
    "summary": "what are|list|summary|key points|main|overview",
    "analysis": "how|why|explain|analyze|compare",
    "timeline": "when|date|time|timeline",
    "data": "number|amount|cost|price|data|statistics",
    "process": "process|steps|procedure|method",
    "comparison": "difference|versus|vs|compared to",
}
CHUNK_LIMITS = {"summary": 8, "analysis": 6, "timeline": 10, "data": 5, "process": 7, "comparison": 8, "general": 5}
SIMPLE_WORDS = "what is|when|where|who|date|name|title"
COMPLEX_WORDS = "analyze|compare|evaluate|synthesize|implications|relationships|comprehensive|detailed analysis"
# Shares of the token budget for context, critique and refinement.
ALLOCATIONS = {"simple": (0.6, 0.0, 0.4), "normal": (0.4, 0.3, 0.3), "complex": (0.3, 0.4, 0.3)}
CONTEXT_SHARE = 0.7
# What a critique points out, by what it contains.
CRITIQUE_MARKS = {
    "?": "Uncertain information identified",
    "!": "Conflicting information found",
    "∅": "Missing information noted",
    "unsupported": "Unsupported claims detected",
    "incomplete": "Incomplete coverage identified",
}


def question_type(question) -> Column:
    return first_match([(col(question).rlike(f"(?i)({p})"), kind) for kind, p in QUESTION_TYPES.items()], "general")


def chunk_limit(kind) -> Column:
    return first_match([(col(kind) == k, n) for k, n in CHUNK_LIMITS.items()], 5)


def complexity(question) -> Column:
    q = col(question)
    simple = q.rlike(f"(?i)({SIMPLE_WORDS})") & (F.length(q) < 50)
    hard = q.rlike(f"(?i)({COMPLEX_WORDS})") | (F.length(q) > 150) | (F.regexp_count(q, F.lit(r"\?")) > 1)
    return first_match([(simple, "simple"), (hard, "complex")], "normal")


def token_allocation(budget, level) -> Column:
    """``context``, ``critique`` and ``refinement`` tokens of a budget, and the ``prefix`` for chunks."""
    shares = [
        first_match([(col(level) == k, v[i]) for k, v in ALLOCATIONS.items()], F.lit(None).cast("double")) for i in range(3)
    ]
    context, critique, refinement = (F.floor(col(budget) * s).cast("long") for s in shares)
    return F.struct(
        context.alias("context"), critique.alias("critique"), refinement.alias("refinement"),
        (context * CONTEXT_SHARE).alias("prefix"),
    )


# What is removed from an answer, first anywhere, then to the end of a line.
ANSWER_NOISE = (
    r"(?i)\*\*Confidence:\s*(HIGH|MEDIUM|LOW)\*\*",
    r"(?i)Confidence:\s*(HIGH|MEDIUM|LOW)",
    r"(?i)\*\*Rating\*\*",
    r"(?i)Rating:",
    r"(?i)This revised response addresses.*?by:",
    r"(?i)The above.*?claims made\.",
)
ANSWER_TAILS = ("This response addresses", "The above analysis", "This revised", "Note:")


def clean_response(answer) -> Column:
    x = col(answer)
    for pattern in ANSWER_NOISE:
        x = F.regexp_replace(x, pattern, "")
    x = trim(F.regexp_replace(x, r"\n\s*\n\s*\n", "\n\n"))
    for start in ANSWER_TAILS:
        x = F.regexp_replace(x, rf"(?im){start}.*$", "")
    return trim(x)


def critique_flags(critique) -> Column:
    x = F.lower(col(critique))
    return F.array_compact(F.array(*[F.when(F.contains(x, F.lit(mark)), F.lit(says)) for mark, says in CRITIQUE_MARKS.items()]))


def quality_metrics(answer, n_chunks, first_similarity, n_issues) -> Column:
    """Accuracy, completeness, clarity, confidence and their mean for one answer."""
    a, n = col(answer), col(n_chunks)

    def has(*marks):
        return reduce(lambda x, y: x | y, [F.contains(a, F.lit(m)) for m in marks])

    accuracy = F.when(has("[", "Document", "Source") & (n > 0) & (col(n_issues) == 0), 90.0).otherwise(70.0)
    completeness = F.when(n >= 3, 85.0).otherwise(65.0)
    clarity = F.when(has("\n\n", "##", "1."), 80.0).otherwise(60.0)
    confidence = F.when(n > 0, F.least(F.lit(95.0), col(first_similarity) * 100)).otherwise(50.0)
    return F.struct(
        accuracy.alias("accuracy"), completeness.alias("completeness"), clarity.alias("clarity"),
        confidence.alias("confidence"), ((accuracy + completeness + clarity + confidence) / 4).alias("rating"),
    )


def thinking_preview(text, size: int = 200) -> Column:
    x = col(text)
    return F.concat(F.substring(x, 1, size), F.when(F.length(x) > size, "...").otherwise(""))


def strip_thinking(text) -> Column:
    """An answer without thinking tags and without a reasoning preamble that ends in a Response heading."""
    x = F.regexp_replace(col(text), r"(?is)<think(?:ing)?>(.*?)</think(?:ing)?>", "")
    x = F.regexp_replace(x, r"(?is)\A.*?AI Reasoning Process.*?Response\s*", "")
    return trim(F.regexp_replace(x, r"(?is)\A.*?Final Enhancement.*?Response\s*", ""))


def thinking_parts(text) -> Column:
    """Parts of a text in order: ``type`` text or thinking, ``content`` trimmed, empty ones left out.

    Cuts at the tags: pieces after an opening tag are thinking up to the closing one.
    """
    x = col(text)
    pieces = F.split(F.regexp_replace(x, r"(?s)<think(?:ing)?>(.*?)</think(?:ing)?>", "\u0001$1\u0002"), "(?=\u0001)|\u0002")
    parts = F.transform(
        pieces,
        lambda p: F.struct(
            F.when(F.startswith(p, F.lit("\u0001")), "thinking").otherwise("text").alias("type"),
            trim(F.replace(p, F.lit("\u0001"), F.lit(""))).alias("content"),
        ),
    )
    kept = F.filter(parts, lambda p: p["content"] != "")
    whole = F.array(F.struct(F.lit("text").alias("type"), x.alias("content")))
    return F.when(F.size(kept) == 0, whole).otherwise(kept)


# -- extraction quality and language --------------------------------------------------------------

# Frequent words by language, in the order in which ties are settled.
LANGUAGE_WORDS = {
    "English": "the and or but in on at to for of with by is are".split(),
    "Spanish": "el la de que y en un es se no".split(),
    "French": "le de et à un il être en avoir que".split(),
    "German": "der die und in den von zu das mit sich".split(),
}
ENGLISH_PARTS = "the and or but in on at to for of with by".split()


def _ascii_word(word: str) -> str:
    """A pattern for a word between ASCII word boundaries; a letter beyond ASCII is no word character."""
    before = r"(?<!\w)" if word[0].isascii() else r"(?<=\w)"
    after = r"(?!\w)" if word[-1].isascii() else r"(?=\w)"
    return before + word + after


def detect_language(text) -> Column:
    """The language with most frequent words in the first 2000 characters, if more than five.

    The sample is cut into ASCII words once, and each language's words are counted among them; the few words that
    begin or end with another letter are counted by pattern.
    """

    def of(x, ws):
        plain = [w for w in ws if w.isascii()]
        odd = [F.regexp_count(x["sample"], F.lit(_ascii_word(w))) for w in ws if not w.isascii()]
        return total([F.size(F.filter(x["runs"], lambda r: r.isin(plain))), *odd])

    def counted(sample):
        cut = F.struct(sample.alias("sample"), F.split(sample, "[^a-z0-9_]+").alias("runs"))
        return let(cut, lambda x: F.struct(*[of(x, ws).alias(name) for name, ws in LANGUAGE_WORDS.items()]))

    def named(n):
        top = F.greatest(*[n[x] for x in LANGUAGE_WORDS])
        return F.when(top > 5, first_match([(n[x] == top, x) for x in LANGUAGE_WORDS], "Unknown")).otherwise("Unknown")

    sample = F.lower(F.substring(col(text), 1, 2000))
    empty = F.coalesce(F.length(col(text)), F.lit(0)) == 0
    return F.when(empty, "en").otherwise(let(let(sample, counted), named))


def detect_english(text) -> Column:
    """English if the first 1000 characters contain more than five frequent words, also within words."""
    sample = F.lower(F.substring(col(text), 1, 1000))
    n = total([F.size(F.split(sample, w)) - 1 for w in ENGLISH_PARTS])
    return F.when(n > 5, "English").otherwise("Unknown")


def text_confidence(text) -> Column:
    """How sure an extracted page text looks, 0 to 100."""
    x = col(text)
    n, w = F.length(x), F.size(words(x))
    add = [
        (n > 100, 20), (n > 500, 10), (w > 20, 10), (w > 100, 5), (F.contains(x, F.lit("\n\n")), 5), (x.rlike("[.!?]"), 5),
        (x.rlike("[A-Z][a-z]"), 5), (n < 50, -20), (~x.rlike("[a-zA-Z]"), -30),
    ]
    score = F.lit(50) + total([F.when(c, v).otherwise(0) for c, v in add])
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


# Success rate, characters a page, mean confidence that a quality needs.
QUALITY_BOUNDS = {"enhanced": ((0.9, 800, 80), (0.7, 400, 60)), "advanced": ((0.9, 500, None), (0.7, 200, None))}


def extraction_quality(successful, pages, chars, confidence=None, profile: str = "enhanced") -> Column:
    rate, density = col(successful) / col(pages), col(chars) / col(pages)
    cases = []
    for (r, d, c), name in zip(QUALITY_BOUNDS[profile], ("high", "medium")):
        holds = (rate >= r) & (density > d)
        cases.append((holds & (col(confidence) > c) if c is not None else holds, name))
    return first_match(cases, "low")


# -- formats --------------------------------------------------------------------------------------


def file_size(n) -> Column:
    """``1.5 KB`` and the like: steps of 1024, two decimals, no trailing zeros."""
    x = col(n).cast("double")
    units = ("Bytes", "KB", "MB", "GB", "TB")
    step = F.least(F.floor(F.log(x) / F.log(F.lit(1024.0))), F.lit(len(units) - 1)).cast("int")
    number = F.regexp_replace(F.format_string("%.2f", F.round(x / F.pow(F.lit(1024.0), step), 2)), r"\.?0+$", "")
    return F.when(x <= 0, "0 Bytes").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), step + 1)))


def confidence_share(x) -> Column:
    """A confidence given as a share or as percent, as a share in 0..1."""
    c = col(x).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))


def first_given(*xs) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs])


def uptime(seconds) -> Column:
    s = col(seconds).cast("long")
    parts = (F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.format_string("%02d:%02d:%02d", *(p.cast("long") for p in parts))


def response_time(ms) -> Column:
    x = col(ms).cast("double")
    return F.when(x < 1000, F.concat(F.round(x).cast("long").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", x / 1000))


def size_label(n) -> Column:
    """A count of characters in thousands: ``3.4k``, below a thousand as it is."""
    x = col(n)
    return F.when(x < 1000, x.cast("string")).otherwise(F.format_string("%.1fk", x / 1000))


def iso_date(ts) -> Column:
    """The day of a time, as in ISO 8601."""
    return F.date_format(col(ts), "yyyy-MM-dd")


def locale_date(ts) -> Column:
    """The day of a time as shown in en-US, ``Unknown`` for none."""
    return F.coalesce(F.date_format(col(ts), "M/d/yyyy"), F.lit("Unknown"))


def locale_time(ts) -> Column:
    """A time as shown in en-US."""
    return F.date_format(col(ts), "M/d/yyyy, h:mm:ss a")


def file_date(text) -> Column:
    """A time from a file's metadata: ``D:YYYYMMDDHHmmSS`` with an offset, cut off anywhere after the year, or ISO 8601; null if it is neither."""
    x = F.trim(col(text))
    digits = F.regexp_extract(x, r"^D:(\d{4,14})", 1)
    # what isn't given is the first month and day, midnight
    whole = F.try_to_timestamp(F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14))), F.lit("yyyyMMddHHmmss"))
    zone = lambda n: F.regexp_extract(x, r"^D:\d{14}([+-])(\d\d)'?(\d\d)?", n)
    number = lambda n: F.coalesce(F.nullif(zone(n), F.lit("")).cast("int"), F.lit(0))
    minutes = F.when(zone(1) == "-", -1).otherwise(1) * (number(2) * 60 + number(3))
    return F.when(digits != "", F.timestamp_add("MINUTE", -minutes, whole)).otherwise(x.try_cast("timestamp"))


def score_band(score) -> Column:
    return first_match([(col(score) >= 0.8, "green"), (col(score) >= 0.6, "yellow")], "red")


def quality_notice(rating) -> Column:
    return first_match([(col(rating) >= 85, "success"), (col(rating) < 60, "warning")], "none")


# What an error message contains, as it is written, and what kind of error that is; the first that fits.
ERROR_KINDS = {
    "authentication": ("API key", "401", "Unauthorized"),
    "model": ("model", "404"),
    "rate_limit": ("rate limit", "429"),
    "network": ("network", "fetch", "timeout"),
    "password": ("password", "encrypted"),
    "corrupt": ("Invalid PDF", "corrupt"),
}


def error_kind(message) -> Column:
    x = col(message)
    cases = [(reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts]), kind) for kind, parts in ERROR_KINDS.items()]
    return first_match(cases, "unknown")


def source_label(name, index) -> Column:
    return F.concat(col(name), F.lit(" (chunk "), (col(index) + 1).cast("string"), F.lit(")"))


def source_document(source) -> Column:
    return F.element_at(F.split(col(source), r" \(chunk "), 1)


def parse_list(text) -> Column:
    return F.filter(F.transform(F.split(col(text), ","), trim), lambda x: x != "")


# -- deterministic stand-in for a language model ---------------------------------------------------


def offline_answer(prompt) -> Column:
    """A reply that needs no model: what was asked, by class of request."""
    asked = words(F.lower(col(prompt)))

    def any_of(*ws):
        return F.arrays_overlap(asked, F.array(*map(F.lit, ws)))

    kind = first_match(
        [(any_of("summary", "summarize", "overview"), "Summary requested."), (any_of("find", "search", "locate", "where"), "Search requested.")],
        "No language model is configured.",
    )
    return F.concat(F.lit('You asked: "'), thinking_preview(prompt, 100), F.lit('"\n\n'), kind)

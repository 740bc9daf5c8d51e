"""Main text of HTML pages: nearest-URL page differencing over structural blocks.

1. Pages are dealt by ranges of (host, path, page_id), so a host of any size is many tasks. A page's partner is its
   neighbour in that order, within its host: the one before or after it, whichever shares more leading segments; if that one has
   no line in common or is a copy, the other. Pages with null or empty html are passed over. Of each range the first and last page with html
   go to the next ranges as well, so neighbours meet across borders.
2. Each page and its partner are cut into text lines, one for each block element. All their lines are
   aligned by longest common subsequence, and shared lines are deleted. Lines inside ``article`` and ``main`` go only if
   the neighbours on both sides share them: articles repeat sentences (licences, say) here and there, notices of a site are on every
   page. If more than half of the lines inside those elements are shared, the article itself is mirrored, and they stay.
3. Elements that are never article (scripts, forms, menus, asides, adverts, comments ...) go by
   their tag, role or class. If a page has an article or main element, only its lines are kept.

Pages all of whose lines are shared are copies of each other; the pair says nothing and nothing is deleted.

Defined results: null or empty html gives an empty text; markup that ends within a tag or a character
reference is read up to there; a null URL is a host of its own; rows that repeat a page are never
their own partner; ties of nearness go to the smaller path, then the smaller ``page_id``; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

#: Sampled pages for each range.
PER_RANGE = 50

# Element names by what they do to text.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option",
    "textarea", "iframe", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "title", "xmp", "noembed",
    "noframes", "datalist", "label", "fieldset", "map",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar",
    "form", "toolbar", "status",
}
LABELS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "legal", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo",
    "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Za-z][a-z]*")
_BLANK = re.compile(r"\s+")


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all in it is never article text."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if tag == "article":
        return bool(_labels(named) & {"comment", "comments", "reply"})
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or named.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", ""), re.IGNORECASE):
        return True
    labels = _labels(named)
    return bool(labels & LABELS) or ("header" in labels and not in_article)


def _labels(named: dict[str, str]) -> set[str]:
    return {w.lower() for w in _WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}")}


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """Text blocks in page order: text, whether inside an article or main element, whether unwanted."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, in article, unwanted, unwanted within a line
    places: dict[str, list[int]] = {}  # where each name is open, so that an end tag costs what it closes
    open_blocks: list[int] = []
    article = dropped = silent = False
    at, html = 0, html or ""

    def close(depth: int):
        for i in range(len(open_tags) - 1, depth - 1, -1):
            places[open_tags[i][0]].pop()
        del open_tags[depth:]
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()

    def flush():
        text = _BLANK.sub(" ", unescape("".join(held))).strip()
        if text:
            out.append((text, article, dropped))
        held.clear()

    while at < len(html):
        m = _TAG.search(html, at)
        if not silent:
            held.append(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = places[tag][-1] if places.get(tag) else None
            if tag in BLOCK and (depth is not None or tag == "p"):
                flush()
            if depth is None:
                continue
            if open_blocks and open_blocks[-1] >= depth:
                flush()
            close(depth)
        else:
            if not m[4]:
                break  # the page ends within this tag
            if tag == "br" and not silent:
                held.append(" ")
            if tag in BLOCK:
                flush()
            if tag in VOID or (m[3].endswith("/") and tag not in BLOCK and tag not in RAW):
                continue
            if tag in BLOCK and open_blocks and _ends(open_tags[open_blocks[-1]][0], tag):
                close(open_blocks[-1])
            _, inside, gone, quiet = open_tags[-1] if open_tags else ("", False, False, False)
            bad = unwanted(tag, m[3], inside)
            inside = inside or tag in ("article", "main") or _main_role(m[3])
            places.setdefault(tag, []).append(len(open_tags))
            if tag in BLOCK:
                open_blocks.append(len(open_tags))
            open_tags.append((tag, inside, gone or (bad and tag in BLOCK), quiet or (bad and tag not in BLOCK)))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
        _, article, dropped, silent = open_tags[-1] if open_tags else ("", False, False, False)
    flush()
    return out


def _ends(block: str, tag: str) -> bool:
    """Whether the innermost block ends where ``tag`` begins: a paragraph at the next block, an item at the next item of its list."""
    return block == "p" or (block == tag and tag in ("li", "dt", "dd", "tr", "td", "th"))


def _main_role(attributes: str) -> bool:
    return "role" in attributes and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes))


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of lines; memory is two rows of bits."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner = _middle(a[start : len(a) - end], b[start : len(b) - end])
    return [*range(start), *(start + i for i in inner), *range(len(a) - end, len(a))]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int64)
    where: dict[str, np.ndarray] = {}
    numbers: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        numbers.setdefault(line, []).append(j)
    where = {line: np.array(js) for line, js in numbers.items()}
    for line in a:
        if line in where:
            new = row.copy()
            js = where[line]
            new[js + 1] = row[js] + 1
            row = np.maximum.accumulate(np.maximum(new, row))
    return row


def _middle(a: list[str], b: list[str]) -> list[int]:
    """Longest common subsequence by halving (Hirschberg), so memory stays linear."""
    known = set(b)
    mine = [i for i, line in enumerate(a) if line in known]
    if not mine or not b:
        return []
    if len(mine) == 1:
        return mine
    half = mine[len(mine) // 2]
    left = _lengths(a[:half], b)
    right = _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int((left + right).argmax())
    return [*_middle(a[:half], b[:cut]), *(half + i for i in _middle(a[half:], b[cut:]))]


def main_text(html: str | None, *partners: list[str] | None) -> str:
    """The article of a page; ``partners`` are all lines of its neighbours, the nearest first."""
    return _article(blocks(html), [lines or [] for lines in partners])


def _article(found: list[tuple[str, bool, bool]], partners: list[list[str]]) -> str:
    """The article among blocks; of the partners, nearest first, those count that share some lines, but not all."""
    mine = [text for text, _, _ in found]
    usable = [s for s in (set(common_lines(mine, lines)) for lines in partners) if 0 < len(s) < len(found)]
    shared = usable[0] if usable else set()
    own = {i for i, (_, inside, gone) in enumerate(found) if inside and not gone}
    on_both_sides = shared & own & usable[1] if len(usable) > 1 and 2 * len(shared & own) <= len(own) else set()
    shared = (shared - own) | on_both_sides
    left = [(text, inside) for i, (text, inside, gone) in enumerate(found) if not gone and i not in shared]
    if any(inside for _, inside in left):
        left = [(text, inside) for text, inside in left if inside]
    return "\n\n".join(text for text, _ in left)


class _Run:
    """Rows of one page, which are never each other's partners."""

    def __init__(self, key: tuple):
        self.key, self.rows, self.found = key, [], {}

    def add(self, page_id, url, html: str, border: bool) -> None:
        if html not in self.found:
            self.found[html] = blocks(html)
        if not border:
            self.rows.append((page_id, url, html))

    def lines(self) -> list[str]:
        return [text for text, _, _ in next(iter(self.found.values()))]

    def texts(self, before: _Run | None, after: _Run | None):
        near = [r for r in (before, after) if r is not None and r.key[1] == self.key[1]]
        near.sort(key=lambda r: -_segments(r.key[2], self.key[2]))
        partners = [r.lines() for r in near] if self.rows else []
        text = {html: _article(found, partners) for html, found in self.found.items()} if self.rows else {}
        for page_id, url, html in self.rows:
            yield page_id, url, text[html]


def _segments(a: str, b: str) -> int:
    """How many leading segments two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _texts(batches):
    before = now = None
    columns = ("part", "host", "path", "id", "border", "page_id", "url", "html")
    for big in batches:
        for at in range(0, big.num_rows, 64):
            batch = big.slice(at, 64)
            for part, host, path, id, border, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in columns)):
                if not html:
                    yield page_id, url, ""
                    continue
                key = (part, host, path, id)
                if now is None or key != now.key:
                    after = _Run(key)
                    after.add(page_id, url, html, border)
                    if now is not None:
                        yield from now.texts(_same(before, now), _same(after, now))
                    before, now = now, after
                else:
                    now.add(page_id, url, html, border)
    if now is not None:
        yield from now.texts(_same(before, now), None)


def _same(other: _Run | None, run: _Run) -> _Run | None:
    return other if other is not None and other.key[0] == run.key[0] else None


def _extract(batches):
    rows = _texts(batches)
    while some := list(islice(rows, 256)):
        ids, urls, texts = zip(*some)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def _places(pages: DataFrame) -> DataFrame:
    """``pages`` with their place in the order: ``host``, ``path``, ``id`` (a null ``page_id`` is first)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    return (
        pages.withColumn("_bare", bare)
        .withColumn("_site", F.regexp_extract("_bare", r"^[^/]*", 0))
        .withColumn("host", F.lower("_site"))
        .withColumn("path", F.regexp_replace(F.expr("substring(_bare, length(_site) + 1)"), r"/+$", ""))
        .withColumn("id", F.coalesce("page_id", F.lit(-(2**63))))
        .drop("_bare", "_site")
    )


def _ranges(keys: DataFrame, parts: int) -> list[tuple]:
    """Places that cut the order into ``parts`` ranges, from a bounded sample."""
    n = keys.count()
    draw = F.pmod(F.xxhash64("host", "path", "id"), F.lit(2**30)) < F.lit(int(2**30 * min(1.0, parts * PER_RANGE / max(1, n))))
    seen = sorted(tuple(r) for r in keys.where(draw).select("host", "path", "id").limit(4 * parts * PER_RANGE).toLocalIterator())
    return sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else []


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every row of ``pages``."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    placed = _places(pages)
    usable = F.coalesce(F.length("html") > 0, F.lit(False))
    keys = materialize(placed.select("host", "path", "id", usable.alias("usable")), "places")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(_ranges(keys, parts))

    @F.pandas_udf("int")
    def range_of(host: pd.Series, path: pd.Series, id: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts.value, x) for x in zip(host, path, id)], dtype="int32")

    part = range_of("host", "path", "id").alias("part")
    place = F.struct("host", "path", "id")
    ends = keys.where("usable").select(part, place.alias("place")).groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    ends = sorted(ends.collect(), key=lambda r: r["part"])  # one row for each range
    borders = [(*a["high"], b["part"]) for a, b in zip(ends, ends[1:])] + [(*b["low"], a["part"]) for a, b in zip(ends, ends[1:])]
    borders = F.broadcast(spark.createDataFrame(borders, "host string, path string, id long, part int"))
    columns = ["part", "host", "path", "id", "border", "page_id", "url", "html"]
    own = placed.select(part, "host", "path", "id", F.lit(False).alias("border"), "page_id", "url", "html")
    also = placed.where(usable).join(borders, ["host", "path", "id"]).withColumn("border", F.lit(True)).select(columns)
    rows = own.unionByName(also.dropDuplicates(["part", "host", "path", "id"]))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "host", "path", "id", "border")
    return arrow_map(dealt, _extract, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html": op1_html}
ORACLES: dict[str, str] = {}

"""Predicates on documents and chunks, from plain options to a Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Filters:
    """What to search in; empty lists and None ask for nothing."""

    document_ids: list = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    min_similarity: float | None = None

    def similarity(self) -> float:
        return 0.05 if self.min_similarity is None else self.min_similarity


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def document_filter(f: Filters, doc_id="doc_id", author="author", tags="tags", date="date") -> Column:
    """Ids as listed, authors whatever their case, any shared tag, dates inclusive, open where one end is missing; no date passes."""
    found = []
    if f.document_ids:
        found.append(F.col(doc_id).isin(list(f.document_ids)))
    if f.authors:
        found.append(F.lower(F.coalesce(F.col(author), F.lit(""))).isin([a.lower() for a in f.authors]))
    if f.tags:
        found.append(F.coalesce(F.arrays_overlap(F.coalesce(F.col(tags), F.array()), F.array(*map(F.lit, f.tags))), F.lit(False)))
    bounds = [F.col(date) >= F.lit(f.date_from)] if f.date_from is not None else []
    bounds += [F.col(date) <= F.lit(f.date_to)] if f.date_to is not None else []
    if bounds:
        found.append(F.coalesce(all_of(bounds), F.lit(True)))
    return all_of(found)


#: Comparisons of the dictionary form.
OPERATORS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def compile_filter(spec: dict, columns: dict[str, Column] | None = None) -> Column:
    """``{"author": {"$in": [...]}, "date": {"$gte": ..., "$lte": ...}}`` as one predicate; plain values are equal."""
    found = []
    for name, condition in (spec or {}).items():
        c = (columns or {}).get(name, F.col(name))
        tests = condition if isinstance(condition, dict) else {"$eq": condition}
        for op, value in tests.items():
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op}")
            found.append(OPERATORS[op](c, value))
    return all_of(found)


def sound_embedding(chunks: str, embeddings: str, dim: int) -> Column:
    """Documents whose chunks and embeddings pair up and have the query's dimension."""
    c, e = F.col(chunks), F.col(embeddings)
    return F.coalesce((F.size(c) == F.size(e)) & (F.size(e) > 0) & (F.size(F.get(e, F.lit(0))) == dim), F.lit(False))

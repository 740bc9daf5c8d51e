"""The queries of this package and their SQL."""

from importlib import import_module

MODULES = (
    "centroids", "embedding_dedup", "html_extraction", "importance", "language", "line_dedup", "markov", "minhash", "mixing", "neighbours", "packing",
    "secrets", "warc",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

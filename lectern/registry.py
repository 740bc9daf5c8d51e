"""All queries of the library's own operators and their SQL."""

from importlib import import_module

MODULES = ("plans.search", "plans.text", "plans.observe", "plans.library", "plans.streams", "plans.files", "plans.indexes", "plans.models", "plans.states")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""Operators for preparing training data at scale, each with its registered query."""

import sys
from importlib import import_module

from pyspark import cloudpickle

# executors need not have this package installed: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("mixing", "license_scan", "decontamination", "language", "toxicity", "repeated_text", "sharding", "jaccard_join", "url_filter", "exact_dedup", "collocations", "substrings", "whitening")


def _loaded():
    return [import_module(f"paceline.llm.{name}") for name in MODULES]


def queries():
    """Registered queries by name."""
    return {name: run for module in _loaded() for name, run in module.QUERIES.items()}


def oracle_sql():
    """SQL of the queries that SQL can express."""
    return {name: sql for module in _loaded() for name, sql in module.SQL.items()}

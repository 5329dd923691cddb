"""Registry of the reference-side queries and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["evaluation", "retrieval", "history", "store", "scalars", "more", "parsers", "matching", "channels", "pools", "aspects", "similarity", "states", "details", "vectors", "reranker", "identity", "summaries", "market", "tables", "streams", "resampling"]


def _modules():
    return [importlib.import_module(f"tallywright.plans.{name}") for name in MODULES]


def queries() -> dict:
    """All registered queries by name."""
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    """All registered oracle statements by name."""
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}


def FLAGSHIP(spark, sf_dir):
    """Pool statistics, reliability and interval of every query's benchmark price."""
    return queries()["flagship_benchmark"](spark, sf_dir)

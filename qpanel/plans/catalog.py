"""Registry of named queries: a Spark builder and (when SQL can express
it) a DuckDB oracle for each.  ``__spark_entry__`` exposes both."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add a (spark, sf_dir) -> DataFrame builder."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from qpanel.plans import (  # noqa: F401
        queries_edges, queries_evaluate, queries_features, queries_files, queries_forecast, queries_impute, queries_misc, queries_models,
        queries_prepare, queries_profile, queries_rules, queries_runtimes, queries_trees)

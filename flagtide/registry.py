"""Named queries over the driver tables, each with an independent DuckDB oracle.

Every query reads the given tables (or data Spark derives from them) in
full. Feeds that need Python source use the generated corpus
(``sources.tables.CORPUS_SQL``); its expected answers follow from the order
columns alone, so the oracle SQL never parses Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from flagtide.catalog import (  # noqa: F401
        extract, functions, plans, rewrite, run)

"""Operators of a training-data pipeline: deduplication, language, toxicity, licenses, quality, tokens.

Nothing outside this package imports it.  ``QUERIES`` and ``ORACLES`` hold its queries on the shared
tables; ``load_all`` fills them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# task code travels with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if it has one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    import corpus_pipeline
    from demandloom.llm import queries  # noqa: F401

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

"""Every query of the library: its callable and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from lexmill.plans import (  # noqa: E402
    evaluation_queries,  # noqa: F401
    gate_queries,  # noqa: F401
    lookup_queries,  # noqa: F401
    quality_queries,  # noqa: F401
    record_queries,  # noqa: F401
    research_queries,  # noqa: F401
    retrieval_queries,  # noqa: F401
    run_queries,  # noqa: F401
    source_queries,  # noqa: F401
    suite_queries,  # noqa: F401
    text_queries,  # noqa: F401
)

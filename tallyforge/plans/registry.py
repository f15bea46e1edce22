"""Names of queries, their functions and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its own name, with its SQL if it has one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from tallyforge.plans import comparing, filing, identities, matching, naming, scoring, sequencing, voting  # noqa: F401



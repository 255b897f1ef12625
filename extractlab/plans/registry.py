"""Names to queries and, where SQL can express them, to the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from extractlab.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``{name}`` in the oracle stands for the adapter of that name."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = adapters.expanded(oracle)
        return f

    return register

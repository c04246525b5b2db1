"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def r6(column: Column | str) -> Column:
    """Six decimals, the precision of the side-by-side check."""
    return F.round(column, 6)


def joined(array: Column | str) -> Column:
    """Array as sorted text, for comparing sets across engines."""
    return F.array_join(F.array_sort(F.col(array) if isinstance(array, str) else array), ",")

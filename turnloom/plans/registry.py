"""Registry of named queries and their SQL equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.plans import oracle
from turnloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use any view named in `plans.oracle`."""

    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def sql_of(name: str) -> str:
    """The SQL a query was registered with, before views are added."""
    return _SQL[name]


def oracles() -> dict[str, str]:
    """Every query's SQL with the views it uses, once all modules have added theirs."""
    return {name: oracle.complete(sql) for name, sql in _SQL.items()}

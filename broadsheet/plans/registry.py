"""Where named queries and their DuckDB equivalents are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from broadsheet.domain import Domain
from broadsheet.domain import sql as domain_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Registers a function of a Domain under `name`, with SQL over the domain tables if SQL can express it."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Domain(spark, folder))
        if sql is not None:
            ORACLES[name] = domain_sql(sql)
        return f

    return add

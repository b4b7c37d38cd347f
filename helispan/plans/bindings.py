"""Queries of the library's own operators over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _registered() -> None:
    """Import the modules that register queries; they import this one."""
    from helispan.plans import coded, drawn, graphs, labelled, parsed, ranked, sequenced, sheeted, written  # noqa: F401


def queries() -> dict[str, Query]:
    _registered()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(SQL)

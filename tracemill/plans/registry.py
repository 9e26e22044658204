"""Collects the queries of the domain modules and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from tracemill.plans import (  # noqa: F401
        queries_aggregates,
        queries_checks,
        queries_citations,
        queries_evaluation,
        queries_governance,
        queries_corpus,
        queries_extract,
        queries_io,
        queries_joins,
        queries_normalized,
        queries_registry,
        queries_review,
        queries_scalars,
        queries_streams,
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["C2_kde_completeness"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL

"""All queries of the engine by name, with the DuckDB text of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its own or the given name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from tidelake.plans import answers, bulletins, frames, gates, questions, retrieval, series, streams, tools, words  # noqa: F401  they register themselves


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_real_flow"](spark, sf_dir)

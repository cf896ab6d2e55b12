"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kbspark.sources.standins import Tables, with_standins

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` under its name, with the DuckDB SQL of its result."""

    def put(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered already")
        _QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            _SQL[key] = with_standins(sql)
        return fn

    return put


def _load() -> None:
    from kbspark.plans import access, cache, corpus, evaluation, retrieval, sessions, streams, trends, versions  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["eval03_run_metrics"](spark, sf_dir)

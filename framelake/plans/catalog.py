"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return add


def _load() -> None:
    from framelake.plans import queries_columns, queries_files, queries_order, queries_stack, queries_stats, queries_streams, queries_tracks  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.plans.queries_stack import flagship

    return flagship(spark, sf_dir)

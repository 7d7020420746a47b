"""Registered queries of the document engine, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under its name, with the SQL that DuckDB runs for the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from lodestrata.plans import analyses, documents, evaluations, facts, filings, lines, replies, retrieval, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors over all and by group, united without repeats."""
    return queries()["knn_first_wins_union"](spark, sf_dir)

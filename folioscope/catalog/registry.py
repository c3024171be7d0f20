"""Registry of queries and their oracle SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BUILT: dict[tuple[str, str, str], object] = {}


def built_once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """A stored intermediate (an index, a candidate list) that several queries share in one application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def load() -> None:
    """Import every module that registers queries."""
    from folioscope.catalog import (  # noqa: F401
        chapters,
        chunking,
        cleaning,
        collection,
        evaluation,
        generation,
        lexical,
        mcq,
        ranking,
        tables,
        vectors,
    )

"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.queries import assembly, catalog, claims, entities, general, ingest, passages, retrieval, scalar, streams

_MODULES = (general, catalog, claims, retrieval, ingest, entities, passages, scalar, streams, assembly)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by theme in one year, the catalog question asked most."""
    return catalog.QUERIES["a02_distribution_theme"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

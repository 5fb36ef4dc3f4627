"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import data_quality, ingest, retrieval, secrets

MODULES = (retrieval, secrets, ingest, data_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return retrieval.search_all_terms(spark, directory)

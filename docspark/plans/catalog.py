"""Every query of the library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import answers, corpus, growth, retrieval, surfaces, upkeep

_PARTS = (retrieval, corpus, upkeep, answers, surfaces, growth)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_retrieve(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.SQL.items()}

"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import format_queries, layout_queries, pipeline_queries, problems

_MODULES = (layout_queries, format_queries, pipeline_queries, problems)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_queries.f14_documents(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _MODULES for k, f in m.SQL.items()}

"""Every core query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import chapter_queries, join_queries, model_queries, notes_queries, segment_queries, settings_queries, text_queries

_MODULES = (text_queries, segment_queries, chapter_queries, join_queries, model_queries, notes_queries, settings_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["token_health"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

"""Registered queries of the routing operators, with DuckDB SQL of the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name, with the SQL of the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements and withdrawals of each origin AS in each five-minute slot."""
    return QUERIES["slot_features"](spark, sf_dir)


from . import cohort_queries, country_queries, episode_queries, event_queries, impact_queries, judgement_queries, metric_queries, quality_queries, report_queries, route_queries, scalar_queries, series_queries, summary_queries  # noqa: E402, F401

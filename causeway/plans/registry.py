"""Queries over the behavioural operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.plans.queries import ORACLE, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rolling_counts"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

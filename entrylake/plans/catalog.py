"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accounts, activity, knowledge, streams

Query = Callable[[SparkSession, str], DataFrame]
_GROUPS = [accounts, activity, knowledge, streams]


def _in_utc(query: Query) -> Query:
    """The product keeps all times in UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(query) for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.SQL.items()}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return queries()[name](spark, sf_dir)

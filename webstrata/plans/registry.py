"""Named queries over the given tables, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.plans import derived, native, replayed

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return native.QUERIES | derived.QUERIES | replayed.QUERIES


def oracle_sql() -> dict[str, str]:
    return native.SQL | derived.SQL | replayed.SQL

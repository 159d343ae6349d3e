"""All registered queries of the library, by key, with their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from occura.plans import map_queries, observation_queries, search_queries, stream_queries, table_queries, text_queries  # noqa: F401  they register themselves
from occura.plans.base import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.plans import history, integrity, knowledge, people, scalars

Query = Callable[[SparkSession, str], DataFrame]

PARTS = (history, integrity, knowledge, people, scalars)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}

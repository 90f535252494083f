"""Every query of the library by name, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("user", "content", "community", "network", "cascade", "comparison", "influence", "extraction")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _group in GROUPS:
    for _name, (_query, _sql) in import_module(f"tributary.catalog.{_group}").CATALOG.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql


def entry(spark: SparkSession) -> DataFrame:
    """Summary of every cascade: joins, windows and aggregates over derived trees."""
    return QUERIES["cascade_summary"](spark, "/root/testdata/sf0.001")

"""All registered queries of the road-analytics operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "m4_summary_by_direction"
MODULES = ("metrics_queries", "group_queries", "route_queries", "pixel_queries", "dataset_queries", "split_queries", "stream_queries", "source_queries")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"lanepulse.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL

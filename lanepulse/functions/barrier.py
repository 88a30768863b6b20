"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once, however often later expressions name them:
    the optimiser does not copy expressions out of a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))

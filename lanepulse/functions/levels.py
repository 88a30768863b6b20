"""Congestion levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of occupancy and the level names, least congested first.
THRESHOLDS = (0.08, 0.15, 0.25)
LEVELS = ("원활", "서행", "지체", "정체")


def level(occupancy: Column, thresholds: tuple[float, ...] = THRESHOLDS) -> Column:
    """The first level whose bound lies above ``occupancy``; null stays null."""
    out = F.when(occupancy.isNull(), F.lit(None).cast("string"))
    for bound, name in zip(thresholds, LEVELS, strict=False):
        out = out.when(occupancy < bound, name)
    return out.otherwise(LEVELS[len(thresholds)])


def level_number(occupancy: Column, thresholds: tuple[float, ...] = THRESHOLDS) -> Column:
    """0 for the least congested level up to the number of bounds."""
    return sum(((occupancy >= b).cast("int") for b in thresholds), F.lit(0))

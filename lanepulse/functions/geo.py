"""Geometry on the sphere and in local planes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres per degree of longitude at the equator and of latitude.
DEGREE_LON_M, DEGREE_LAT_M = 111_320.0, 110_540.0
#: Compass sectors clockwise from north.
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero on the scaled binary value. Of a value that was rounded before, the decimal digits
    that ``round`` goes by may end in a five whose scaled value lies below one half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # null where a point is


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial heading from the first point to the second, 0 to 360 degrees."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lon) of the point so many metres along a heading."""
    d, h, p = metres / EARTH_M, F.radians(heading), F.radians(lat)
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h)
    dl = F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s)
    return F.degrees(F.asin(s)), lon + F.degrees(dl)


def angle_diff(a: Column, b: Column) -> Column:
    """The smaller angle between two headings, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360 - d)


def compass(heading: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(heading / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def axial_mean(heading: Column) -> Column:
    """Aggregate: the mean axis of headings, 0 to 180, by doubled angles."""
    two = F.radians(heading * 2)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(two)), F.sum(F.cos(two)))) / 2 + 180, F.lit(180.0))


def plane_scale(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and latitude at a latitude."""
    return F.lit(DEGREE_LON_M) * F.cos(F.radians(lat)), F.lit(DEGREE_LAT_M)

"""Coordinates of polygons and storm motion as native columns: hundredths of a degree until a report turns them into
FLOAT degrees, west and negative but for one office."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the one office east of the date line.
EAST_OFFICE = "PGUM"


def longitude(hundredths: Column, office: Column) -> Column:
    """Signed hundredths: values under 40 degrees lack a leading hundred; all but one office lie in the west."""
    full = F.when(hundredths < 4000, hundredths + 10000).otherwise(hundredths)
    return F.when(office == EAST_OFFICE, full).otherwise(-full)


def degrees(points: Column, office: Column) -> Column:
    """Points of hundredths as array<struct<lat float, lon float>>."""
    return F.transform(points, lambda p: F.struct((p["lat"] / 100).cast("float").alias("lat"), (longitude(p["lon"], office) / 100).cast("float").alias("lon")))


def longitude_of(hundredths: int, office: str) -> int:
    """longitude() of one number, for table functions."""
    full = hundredths + 10_000 if hundredths < 4000 else hundredths
    return full if office == EAST_OFFICE else -full

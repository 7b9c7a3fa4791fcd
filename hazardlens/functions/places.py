"""Place text: city and country parts, and a coarse region from coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Fixed values: (region, lat min, lat max, lon min, lon max), bounds inclusive, first hit wins.
# The three Asian entries are cut out of the Asia box, so they carry its bounds as well.
REGION_BOXES = [
    ("North America", 25, 70, -130, -60),
    ("Alaska/Western Canada", 25, 70, -170, -130),
    ("South America", -60, 15, -85, -30),
    ("Europe", 35, 75, -15, 50),
    ("Siberia", 50, 80, 80, 180),
    ("East Asia", 20, 80, 100, 140),
    ("Southeast Asia", 0, 80, 90, 150),
    ("Asia", -10, 80, 50, 180),
    ("Africa", -40, 40, -20, 55),
    ("Australia/Oceania", -50, -5, 110, 180),
]


def _part(text: Column, separator: str, index: int) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(index))


def _or_unknown(place: Column, value: Column) -> Column:
    return F.when(F.coalesce(place, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(value)


def city_of(place: Column) -> Column:
    """Text after the first " of " up to a comma, else text before the first comma."""
    tail = F.when(place.contains(" of "), _part(place, " of ", 2)).otherwise(place)
    return _or_unknown(place, F.trim(_part(tail, ",", 1)))


def country_of(place: Column) -> Column:
    """Text after the last comma."""
    return _or_unknown(place, F.trim(_part(place, ",", -1)))


def comma_part(place: Column, index: int) -> Column:
    """Zero-based comma part, trimmed; NULL where there is no such part."""
    return F.trim(F.get(F.split(place, ","), F.lit(index)))


def region_of(lat: Column, lon: Column) -> Column:
    """Region of a point, or its coordinates as text outside all boxes."""
    out = None
    for name, south, north, west, east in REGION_BOXES:
        inside = (lat >= south) & (lat <= north) & (lon >= west) & (lon <= east)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out.otherwise(F.format_string("%.1f°, %.1f°", lat, lon))


def region_city(region: Column) -> Column:
    """First slash part of a region name."""
    return _part(region, "/", 1)

"""Boundaries of grades, places, regions and texts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions import geometry, grading, numbers, places, texts


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "table,value,expected",
    [
        (params.QUAKE_GRADES_4, 3.99, "Low"), (params.QUAKE_GRADES_4, 4.0, "Moderate"), (params.QUAKE_GRADES_4, 6.0, "High"),
        (params.QUAKE_GRADES_4, 7.0, "Extreme"), (params.FIRE_GRADES_4, 4.99, "Low"), (params.FIRE_GRADES_4, 5.0, "Moderate"),
        (params.FIRE_GRADES_4, 15.0, "High"), (params.FIRE_GRADES_4, 50.0, "Extreme"), (params.QUAKE_GRADES_3, 9.0, "high"),
        (params.FIRE_GRADES_3, 14.9, "moderate"), (params.QUAKE_GRADES_4, None, "Unknown"), (params.FIRE_GRADES_4, float("nan"), "Unknown"),
    ],
)
def test_grades(spark, table, value, expected):
    assert one(spark, grading.grade(F.lit(value).cast("double"), table)) == expected


def test_alert_limits_are_not_the_grade_bounds(spark):
    """A fire graded High starts at 15 but alerts from 50; both tables stand as they are."""
    limit = grading.alert_limit(F.lit("fire"), F.lit("High"))
    assert one(spark, limit) == 50.0
    assert one(spark, grading.grade(F.lit(20.0), params.FIRE_GRADES_4)) == "High"
    assert one(spark, grading.alert_limit(F.lit("fire"), F.lit("Unknown"))) is None


@pytest.mark.parametrize(
    "place,city,country",
    [
        ("5km NE of Town, State", "Town", "State"), ("Town, State", "Town", "State"), ("Ridge", "Ridge", "Ridge"),
        ("", "Unknown", "Unknown"), (None, "Unknown", "Unknown"), ("3km S of A, B, C", "A", "C"),
    ],
)
def test_place_parts(spark, place, city, country):
    p = F.lit(place).cast("string")
    assert one(spark, places.city_of(p)) == city
    assert one(spark, places.country_of(p)) == country


def test_legacy_place_without_comma_gives_null(spark):
    assert one(spark, places.comma_part(F.lit("Ridge"), 1)) is None
    assert one(spark, places.comma_part(F.lit("Town, State"), 1)) == "State"


@pytest.mark.parametrize(
    "lat,lon,region",
    [
        (40, -100, "North America"), (60, -150, "Alaska/Western Canada"), (40, -55, "40.0°, -55.0°"), (-10, -60, "South America"),
        (48, 2, "Europe"), (60, 100, "Siberia"), (35, 120, "East Asia"), (10, 100, "Southeast Asia"), (20, 75, "Asia"),
        (0, 20, "Africa"), (-25, 135, "Australia/Oceania"), (-80, 0, "-80.0°, 0.0°"), (40, -130, "North America"),
    ],
)
def test_regions(spark, lat, lon, region):
    assert one(spark, places.region_of(F.lit(float(lat)), F.lit(float(lon)))) == region


@pytest.mark.parametrize(
    "minutes,text", [(0, "Just now"), (1, "1m ago"), (59, "59m ago"), (60, "1h ago"), (1439, "23h ago"), (1440, "1/31/2024")]
)
def test_relative_age(spark, minutes, text):
    now = dt.datetime(2024, 2, 1, 12)
    time = now - dt.timedelta(minutes=minutes)
    column = texts.relative_age(F.lit(str(time)).cast("timestamp_ntz"), F.lit(str(now)).cast("timestamp_ntz"))
    assert one(spark, column) == text


def test_days_and_numbers(spark):
    assert [one(spark, texts.days_text(F.lit(n))) for n in (0, 1, 3)] == ["Same day", "1 day", "3 days"]
    assert one(spark, texts.count_text(F.lit(None).cast("bigint"))) == "N/A"
    assert one(spark, texts.count_text(F.lit(1234567))) == "1,234,567"
    shown = [one(spark, texts.decimal_text(F.lit(v))) for v in (8.7, 1.025, 0.125, 1234.5)]
    assert shown == ["8.70", "1.02", "0.13", "1234.50"]


@pytest.mark.parametrize("index,label", [(0.8, "Critical"), (0.79, "High"), (0.6, "High"), (0.4, "Medium"), (0.39, "Low")])
def test_vulnerability_labels(spark, index, label):
    assert one(spark, grading.vulnerability_label(F.lit(index))) == label


def test_rounding_and_keys(spark):
    assert one(spark, numbers.round_to(F.lit(2.25), 1)) == 2.3
    assert one(spark, geometry.coordinate_text(F.lit(12.3), F.lit(-0.0))) == "12.300000_0.000000"
    assert one(spark, geometry.snap(F.lit(44.9), 30)) == 30 and one(spark, geometry.snap(F.lit(45.0), 30)) == 60


def test_alert_texts(spark):
    time = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    args = (F.lit("earthquake"), F.lit("High"))
    assert one(spark, texts.alert_subject(*args)) == "ALERT: High Earthquake Detected"
    body = one(spark, texts.alert_body(*args, F.lit(6.5), F.lit("A, B"), time))
    assert "- Value: 6.5" in body and "- Location: A, B" in body and body.endswith("- Time: 2024-01-02 03:04:05")
    assert one(spark, texts.alert_webhook(*args, F.lit(6.5), F.lit("A, B"), time)).splitlines()[0] == "🚨 *High Earthquake Alert*"

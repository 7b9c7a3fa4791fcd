"""Explicit schemas of the feeds and topics; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in fields.items()])


_TEXT, _NUM = StringType(), DoubleType()

# Topic messages. Fire coordinates arrive as quoted text and times as text, so every
# field that can be malformed is decoded as text and cast leniently afterwards.
QUAKE_MESSAGE = _struct(
    id=_TEXT, time=_TEXT, magnitude=_TEXT, place=_TEXT, url=_TEXT, status=_TEXT,
    magType=_TEXT, latitude=_TEXT, longitude=_TEXT,
)
FIRE_MESSAGE = _struct(
    id=_TEXT, time=_TEXT, frp=_TEXT, city=_TEXT, country=_TEXT, latitude=_TEXT, longitude=_TEXT,
)
MESSAGE_NUMBERS = ("magnitude", "frp", "latitude", "longitude")

GEOJSON = _struct(
    features=ArrayType(
        _struct(
            id=_TEXT,
            properties=_struct(
                mag=_NUM, place=_TEXT, time=LongType(), url=_TEXT, type=_TEXT,
                status=_TEXT, magType=_TEXT,
            ),
            geometry=_struct(coordinates=ArrayType(_NUM)),
        )
    )
)

# Coordinates stay text: a polygon nests arrays where a point has two numbers.
NATURAL_EVENTS = _struct(
    events=ArrayType(
        _struct(
            id=_TEXT,
            title=_TEXT,
            link=_TEXT,
            categories=ArrayType(_struct(title=_TEXT)),
            geometry=ArrayType(_struct(date=_TEXT, coordinates=_TEXT)),
        )
    )
)

FIRE_CSV_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time", "frp")

# The unified event row shared by all operators.
HAZARD_EVENT = _struct(
    id=_TEXT, type=_TEXT, time=TimestampNTZType(), latitude=_NUM, longitude=_NUM, place=_TEXT,
    severity=_TEXT, magnitude=_NUM, frp=_NUM, city=_TEXT, country=_TEXT,
)

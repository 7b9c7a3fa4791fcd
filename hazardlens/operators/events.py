"""The unified event row: tagging, grading, padding, dedupe, filters and the feed listing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import params, schemas
from hazardlens.functions import texts
from hazardlens.functions.grading import grade

ALL = "all"


def seconds(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


def latest_time(events: DataFrame, column: str = "time") -> DataFrame:
    """The newest event time as a one-row table, used as "now" over stored events."""
    return events.agg(F.max(column).alias("as_of"))


def moment(as_of, back: float = 0) -> Column:
    """``back`` seconds before "now", which is a datetime or a one-row table such as ``latest_time``.

    Either way the result is one literal for the scan (a scalar subquery is one when the scan
    starts), so filters on event time prune files and row groups.
    """
    if isinstance(as_of, DataFrame):
        bound = F.col(as_of.columns[0])
        return as_of.select((bound - seconds(back) if back else bound).alias("bound")).scalar()
    if isinstance(as_of, dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    bound = F.lit(as_of).cast("timestamp_ntz")
    return bound - seconds(back) if back else bound


def graded(rows: DataFrame, quake_grades=None, fire_grades=None) -> DataFrame:
    """Severity by type: earthquakes by magnitude, fires by radiative power."""
    quake = grade(F.col("magnitude"), quake_grades or params.QUAKE_GRADES_4)
    fire = grade(F.col("frp"), fire_grades or params.FIRE_GRADES_4)
    return rows.withColumn("severity", F.when(F.col("type") == "earthquake", quake).otherwise(fire))


def unify(quakes: DataFrame, fires: DataFrame, quake_grades=None, fire_grades=None) -> DataFrame:
    """Both kinds of event in one graded table; a column that neither side has is a typed NULL."""
    both = quakes.withColumn("type", F.lit("earthquake")).unionByName(
        fires.withColumn("type", F.lit("fire")), allowMissingColumns=True
    )
    both = graded(both, quake_grades, fire_grades)
    columns = []
    for f in schemas.HAZARD_EVENT.fields:
        known = f.name in both.columns
        columns.append(F.col(f.name) if known else F.lit(None).cast(f.dataType).alias(f.name))
    return both.select(*columns)


def event_value() -> Column:
    """Magnitude of an earthquake, radiative power of a fire."""
    return F.coalesce("magnitude", "frp")


def dedupe(events: DataFrame, key: str = "id", arrival: str | None = None) -> DataFrame:
    """One row per key, the earliest by event time and then by arrival.

    A grouped minimum combines map-side, so any number of copies of one key ends as one row
    per task before the shuffle.
    """
    first = ["time"] + ([arrival] if arrival else [])
    rest = [c for c in events.columns if c not in (key, *first)]
    order = [F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("value")).alias(f"_{c}") for c in first]
    row = F.min(F.struct(*order, F.struct(*first, *rest).alias("row"))).alias("first")
    return events.groupBy(key).agg(row).select(key, "first.row.*").select(*events.columns)


def fire_lookback(fires: DataFrame, as_of, minutes: int = 1, hours: int = params.FIRE_LOOKBACK_HOURS) -> DataFrame:
    """Fires not older than ``hours`` and ``minutes`` before ``as_of``; the bound is inclusive."""
    return fires.filter(F.col("time") >= moment(as_of, hours * 3600 + minutes * 60))


def time_range(events: DataFrame, as_of, name: str | None) -> DataFrame:
    """Events of a named look-back range; an unknown name keeps everything."""
    span = params.TIME_RANGES.get(name)
    return events if span is None else events.filter(F.col("time") >= moment(as_of, span))


def event_filter(events: DataFrame, event_type: str = ALL, severity: str = ALL) -> DataFrame:
    if event_type != ALL:
        events = events.filter(F.col("type") == event_type)
    if severity != ALL:
        events = events.filter(F.col("severity") == severity)
    return events


def text_match(query: str, *columns: str) -> Column:
    """Case-insensitive substring match on any of the columns."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return hit


def event_search(events: DataFrame, query: str) -> DataFrame:
    return events.filter(text_match(query, "place", "type")) if query else events


def event_feed(events: DataFrame, as_of) -> DataFrame:
    """Newest first, with the display texts; the id makes the order total."""
    return events.withColumns(
        {
            "age": texts.relative_age(F.col("time"), moment(as_of)),
            "severity_text": F.initcap("severity"),
            "type_text": F.initcap("type"),
        }
    ).orderBy(F.desc("time"), "id")

"""Display texts: ages, day counts, alert messages, numbers with a placeholder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"


def relative_age(time: Column, as_of: Column) -> Column:
    minutes = F.timestamp_diff("MINUTE", time, as_of)
    return (
        F.when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(time, "M/d/yyyy"))
    )


def days_text(days: Column) -> Column:
    return (
        F.when(days == 0, F.lit("Same day"))
        .when(days == 1, F.lit("1 day"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days")))
    )


def count_text(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 0), F.lit(MISSING))


def decimal_text(value: Column) -> Column:
    """Two decimals, rounded on the exact binary value with exact halves up (the halves are eighths)."""
    hundred = value * 100
    half = (value * 8 == F.floor(value * 8)) & (hundred - F.floor(hundred) == 0.5)
    shown = F.format_number(F.when(half, value + 0.001).otherwise(value), 2)
    return F.coalesce(F.replace(shown, F.lit(","), F.lit("")), F.lit(MISSING))


def event_value_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def alert_subject(event_type: Column, severity: Column) -> Column:
    return F.concat(F.lit("ALERT: "), severity, F.lit(" "), F.initcap(event_type), F.lit(" Detected"))


def alert_body(event_type: Column, severity: Column, value: Column, location: Column, time: Column) -> Column:
    lines = [
        alert_subject(event_type, severity),
        F.lit("Details:"),
        F.concat(F.lit("- Type: "), event_type),
        F.concat(F.lit("- Severity: "), severity),
        F.concat(F.lit("- Value: "), event_value_text(value)),
        F.concat(F.lit("- Location: "), location),
        F.concat(F.lit("- Time: "), F.date_format(time, "yyyy-MM-dd HH:mm:ss")),
    ]
    return F.concat_ws("\n", *lines)


def alert_webhook(event_type: Column, severity: Column, value: Column, location: Column, time: Column) -> Column:
    lines = [
        F.concat(F.lit("🚨 *"), severity, F.lit(" "), F.initcap(event_type), F.lit(" Alert*")),
        F.concat(F.lit("*Value:* "), event_value_text(value)),
        F.concat(F.lit("*Location:* "), location),
        F.concat(F.lit("*Time:* "), F.date_format(time, "yyyy-MM-dd HH:mm:ss")),
    ]
    return F.concat_ws("\n", *lines)

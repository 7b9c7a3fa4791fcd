"""Alerts: candidates over their limit, a cooldown per alert key, and message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions import texts
from hazardlens.functions.grading import alert_limit
from hazardlens.functions.rows import evaluate_once
from hazardlens.operators import cooldown
from hazardlens.operators.events import event_value

ALERT_COLUMNS = ["event_type", "severity", "value", "location", "alert_time", "event_id"]


def location_text() -> Column:
    return F.concat_ws(", ", F.coalesce("city", F.lit("Unknown")), F.coalesce("country", F.lit("Unknown")))


def alert_candidates(events: DataFrame, limits=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events whose value reaches the limit of their type and severity; other columns of theirs can be kept.

    The limits are a parameter table of a few entries and become a CASE expression, so the
    lookup needs neither a join nor a broadcast.
    """
    named = evaluate_once(
        events.filter(event_value().isNotNull()),
        "severity", event_value().alias("value"),
        beside=[*dict.fromkeys(["id", "type", "city", "country", "time", *keep])],
    )
    limit = alert_limit(F.col("type"), F.col("severity"), limits)
    return named.filter(F.col("value") >= limit).select(
        F.concat_ws("_", "type", "severity").alias("alert_key"),
        F.col("id").alias("event_id"),
        F.col("type").alias("event_type"),
        "severity", "value", limit.alias("alert_limit"),
        location_text().alias("location"),
        "time",
        *keep,
    )


def alerts(events: DataFrame, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS, limits=None) -> DataFrame:
    """Alerts that pass the limit and the cooldown of their (type, severity)."""
    fired = cooldown.apply(alert_candidates(events, limits), cooldown_seconds)
    return fired.select("event_type", "severity", "value", "location", F.col("second").alias("alert_time"), "event_id")


def alert_messages(fired: DataFrame) -> DataFrame:
    """Alert rows with the ready texts for mail and webhook."""
    kind, severity, value = F.col("event_type"), F.col("severity"), F.col("value")
    location, time = F.col("location"), F.col("alert_time")
    return fired.withColumns(
        {
            "subject": texts.alert_subject(kind, severity),
            "body": texts.alert_body(kind, severity, value, location, time),
            "webhook_text": texts.alert_webhook(kind, severity, value, location, time),
        }
    )

"""Alerts in the order of event time, however their events arrive within the watermark.

Two stateful steps follow one another. The first combines the candidates of an alert key and second to one, in the JVM and
map-side first, and gives a second away when the watermark has passed it: from then on nothing of it can come. So the second
step sees the seconds of a key in order, batch after batch, and needs no more state than the second from which
the key may fire again. Its input is at most one row for each key and second, whatever the number of events.

The result equals that of the stored table up to the watermark. ``jobs.start_alerts`` alerts at once, in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hazardlens import params
from hazardlens.operators import alerts, cooldown
from hazardlens.streaming import jobs, sinks

#: The state store that keyed state needs; Spark brings it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ALERTS = "event_type string, severity string, value double, location string, alert_time timestamp, event_id string"
_OUT = f"alert_key string, s bigint, {_ALERTS}"


class _Cooldown(StatefulProcessor):
    """One value per alert key: the epoch second before which it may not fire."""

    def __init__(self, seconds: int):
        self.seconds = max(1, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.allowed = handle.getValueState("allowed", "allowed bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(rows).sort_values("s", ignore_index=True)
        allowed = self.allowed.get()[0] if self.allowed.exists() else cooldown.NEVER
        seconds = seen["s"].to_numpy()
        fired = cooldown.fire_block(seconds, allowed, self.seconds)
        if len(fired):
            self.allowed.update((int(fired[-1]) + self.seconds,))
            yield seen.iloc[np.searchsorted(seconds, fired)]

    def close(self) -> None:
        pass


def per_second(events: DataFrame, limits=None) -> DataFrame:
    """The best candidate of each alert key and second: the largest value, then the smallest id."""
    shown = F.struct("event_type", "severity", "value", "location", F.date_trunc("second", "time").alias("alert_time"), "event_id")
    best = F.min(F.struct((-F.col("value")).alias("rank"), "event_id", shown.alias("row"))).alias("best")
    combined = alerts.alert_candidates(events, limits).groupBy(F.window("time", "1 second").alias("w"), "alert_key").agg(best)
    return combined.select("alert_key", F.unix_seconds("w.start").alias("s"), "best.row.*")


def ordered_alerts(events: DataFrame, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS, limits=None) -> DataFrame:
    """Alerts of a watermarked event stream, each a second after the watermark has passed it."""
    if cooldown_seconds < 0:
        raise ValueError("a cooldown cannot be negative")
    keyed = per_second(events, limits).groupBy("alert_key")
    fired = keyed.transformWithStateInPandas(_Cooldown(cooldown_seconds), _OUT, "append", "none")
    return fired.drop("alert_key", "s")


def start_ordered_alerts(
    events: DataFrame, path: str | None, checkpoint: str, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS,
    mode: str = "parquet", trigger: dict[str, object] | None = None, name: str = "ordered_alerts",
) -> StreamingQuery:
    """As ``jobs.start_alerts``, in event-time order. The query starts with the state store that keyed state needs."""
    conf, setting = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(setting, None)
    out = ordered_alerts(events, cooldown_seconds)
    writer = sinks.writer(out, mode, path, checkpoint, name, trigger or {"processingTime": params.EVENT_TRIGGER}, F.col("event_id"), F.col("alert_time"))
    conf.set(setting, STORE)
    try:
        return writer.start()
    finally:
        conf.set(setting, before) if before else conf.unset(setting)


def run_ordered_alerts(
    events: DataFrame, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS, arrivals: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    """Drain what is there, then start anew for each arrival; the alerts up to the watermark."""
    def start(path: str, checkpoint: str) -> StreamingQuery:
        return start_ordered_alerts(events, path, checkpoint, cooldown_seconds, trigger=jobs.DRAIN, name=jobs._own_name("ordered"))

    spark: SparkSession = events.sparkSession
    return jobs._drain(spark, "ordered", start, _ALERTS, arrivals)

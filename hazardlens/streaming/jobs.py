"""The streaming jobs: ingest, metrics, dedupe and alerts.

All of them take a ``watermarked`` event stream. Every ``start_*`` starts one named query with its
own checkpoint; every ``run_*`` drains what is available, ends, and returns the written table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazardlens import params, schemas
from hazardlens.functions import places
from hazardlens.operators import alerts, cooldown, geo, metrics
from hazardlens.operators.events import unify
from hazardlens.sources import topic
from hazardlens.sources.tables import shared_folder
from hazardlens.streaming import sinks

DRAIN = {"availableNow": True}
#: A batch that runs again needs the table of the batch before it, so the two must differ.
ALERT_STATES = 3
_PLACED = ("latitude", "longitude", "city", "country")


def watermarked(events: DataFrame, delay: str = params.WATERMARK) -> DataFrame:
    """Event time as a timestamp with the watermark; later rows are dropped by stateful steps."""
    return events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)


def event_stream(
    quake_messages: DataFrame,
    fire_messages: DataFrame,
    quake_grades=None,
    fire_grades=None,
    comma_places: bool = False,
) -> DataFrame:
    """Both topics decoded, named, graded, unified and watermarked.

    Earthquakes take city and country from the place text: around " of " and the last comma, or
    with ``comma_places`` simply the first two comma parts. Rows without a readable time cannot
    take part in event time; ``start_rejects`` lists them. Each feed has its own watermark, so the feed that lags
    is not late against the other one: the time of a query is the smaller of both.
    """
    place = F.col("place")
    if comma_places:
        named = {"city": places.comma_part(place, 0), "country": places.comma_part(place, 1)}
    else:
        named = {"city": places.city_of(place), "country": places.country_of(place)}
    timed = F.col("time").isNotNull()
    quakes = watermarked(topic.decode_messages(quake_messages, schemas.QUAKE_MESSAGE).filter(timed).withColumns(named))
    fires = watermarked(topic.decode_messages(fire_messages, schemas.FIRE_MESSAGE).filter(timed))
    return unify(quakes, fires, quake_grades, fire_grades)


def rejected(quake_messages: DataFrame, fire_messages: DataFrame) -> DataFrame:
    """What ``event_stream`` leaves out of either topic, and numbers that are not finite, with the reason."""
    quakes = topic.message_rejects(quake_messages, schemas.QUAKE_MESSAGE).withColumn("topic", F.lit("earthquake"))
    return quakes.union(topic.message_rejects(fire_messages, schemas.FIRE_MESSAGE).withColumn("topic", F.lit("fire")))


def dedupe_stream(events: DataFrame, key: str = "id") -> DataFrame:
    """First arrival per id; a repeat carries the same event time, so the watermark bounds the state."""
    return events.dropDuplicatesWithinWatermark([key])


def _every(interval: str) -> dict[str, object]:
    return {"processingTime": interval}


def _event_moment(events: DataFrame) -> Column:
    return F.coalesce(*[F.col(c).cast("timestamp") for c in ("kafka_timestamp", "time") if c in events.columns])


def start_ingest(
    events: DataFrame,
    path: str | None,
    checkpoint: str,
    gazetteer: DataFrame | None = None,
    radius_km: float = 50.0,
    trigger: dict[str, object] | None = None,
    name: str = "event_ingest",
    mode: str = "parquet",
) -> StreamingQuery:
    """Deduplicated events in any output mode; with a gazetteer missing places are filled per batch.

    As parquet they are a table by type and event date, safe against replays; ``sinks.compact`` joins its files.
    """
    save = sinks.deliver(path, mode, F.col("id"), _event_moment(events), by=("type", "event_date"))

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            out = geo.reverse_geocode(kept, gazetteer, radius_km) if gazetteer is not None else kept
            save(out.withColumn("event_date", F.to_date("time")) if mode == "parquet" else out, batch_id)
        finally:
            kept.unpersist()

    return (
        dedupe_stream(events).writeStream.queryName(name)
        .trigger(**(trigger or _every(params.EVENT_TRIGGER)))
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .start()
    )


def start_rejects(
    quake_messages: DataFrame, fire_messages: DataFrame, path: str, checkpoint: str,
    trigger: dict[str, object] | None = None, name: str = "rejects",
) -> StreamingQuery:
    """The side table of the messages that no event row comes from."""
    return sinks.writer(rejected(quake_messages, fire_messages), "parquet", path, checkpoint, name, trigger or _every(params.EVENT_TRIGGER)).start()


def start_metrics(
    events: DataFrame, path: str | None, checkpoint: str, mode: str = "parquet",
    trigger: dict[str, object] | None = None, name: str = "metrics",
) -> StreamingQuery:
    """Window metrics; a row is written once, when the watermark passes the end of its window."""
    out = metrics.window_metrics(events)
    key = F.concat_ws("_", F.date_format("window_start", "yyyyMMddHHmmss"), "type", "severity")
    return sinks.writer(out, mode, path, checkpoint, name, trigger or _every(params.METRIC_TRIGGER), key, F.col("window_end")).start()


def start_alerts(
    events: DataFrame, path: str | None, checkpoint: str, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS,
    mode: str = "parquet", trigger: dict[str, object] | None = None, name: str = "alerts",
    gazetteer: DataFrame | None = None, radius_km: float = 50.0,
) -> StreamingQuery:
    """Alerts with a cooldown per type and severity, each batch solved like a stored table.

    What is carried over is one second per alert key: one of ``ALERT_STATES`` small tables beside the checkpoint, which
    batches take in turn. A batch starts from the table of the batch before it and overwrites its own, so a replay gives the
    same alerts and the same table. With a gazetteer the alerts that fire get the places that their events lack.
    """
    if cooldown_seconds < 0:
        raise ValueError("a cooldown cannot be negative")
    states = f"{checkpoint.rstrip('/')}-allowed"
    save = sinks.deliver(path, mode, F.col("event_id"), F.col("alert_time"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "alert_key string, allowed bigint"
        state = lambda batch: f"{states}/turn={batch % ALERT_STATES}"
        before = spark.read.schema(schema).parquet(state(batch_id - 1)) if batch_id else spark.createDataFrame([], schema)
        kept = batch.persist()
        fired = cooldown.apply(kept, cooldown_seconds, entry=before).persist()
        try:
            epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', second)")
            latest = fired.select("alert_key", (epoch + max(1, cooldown_seconds)).alias("allowed")).union(before)
            latest.groupBy("alert_key").agg(F.max("allowed").alias("allowed")).coalesce(1).write.mode("overwrite").parquet(state(batch_id))
            shown = fired
            if gazetteer is not None:
                shown = geo.reverse_geocode(fired, gazetteer, radius_km).withColumn("location", alerts.location_text())
            save(shown.select("event_type", "severity", "value", "location", F.col("second").alias("alert_time"), "event_id"), batch_id)
        finally:
            fired.unpersist()
            kept.unpersist()

    candidates = alerts.alert_candidates(events, keep=_PLACED if gazetteer is not None else ())
    return (
        candidates.writeStream.queryName(name)
        .trigger(**(trigger or _every(params.EVENT_TRIGGER)))
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .start()
    )


def start_all(
    quake_messages: DataFrame, fire_messages: DataFrame, folder: str, checkpoints: str,
    gazetteer: DataFrame | None = None, trigger: dict[str, object] | None = None,
) -> list[StreamingQuery]:
    """Ingest, metrics, alerts and rejects of both topics, each into its own table under ``folder``."""
    events = event_stream(quake_messages, fire_messages)
    return [
        start_ingest(events, f"{folder}/events", f"{checkpoints}/events", gazetteer, trigger=trigger),
        start_metrics(events, f"{folder}/metrics", f"{checkpoints}/metrics", trigger=trigger),
        start_alerts(events, f"{folder}/alerts", f"{checkpoints}/alerts", trigger=trigger, gazetteer=gazetteer),
        start_rejects(quake_messages, fire_messages, f"{folder}/rejects", f"{checkpoints}/rejects", trigger=trigger),
    ]


def await_any(spark: SparkSession) -> None:
    """Block until one of the started queries ends, whichever it is."""
    spark.streams.awaitAnyTermination()


def _own_name(name: str) -> str:
    """Query names must differ inside a session."""
    return f"{name}_{uuid.uuid4().hex[:8]}"


def _drain(
    spark: SparkSession, name: str, start: Callable[[str, str], StreamingQuery], schema, arrivals: Sequence[Callable[[], None]]
) -> DataFrame:
    """Drain what is there; then, for each arrival, let it land and start the query again from its checkpoint."""
    folder = shared_folder(spark, name)
    sinks.finish(start(f"{folder}/table", f"{folder}/checkpoint"))
    for land in arrivals:
        land()
        sinks.finish(start(f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.schema(schema).parquet(f"{folder}/table").drop("batch_id", "event_date")


def run_metrics(events: DataFrame, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    return _drain(
        events.sparkSession, "metrics",
        lambda path, checkpoint: start_metrics(events, path, checkpoint, trigger=DRAIN, name=_own_name("metrics")),
        metrics.window_metrics(events).schema, arrivals,
    )


def run_dedupe(events: DataFrame, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    return _drain(
        events.sparkSession, "events",
        lambda path, checkpoint: start_ingest(events, path, checkpoint, trigger=DRAIN, name=_own_name("events")),
        events.schema, arrivals,
    )


def run_cells(events: DataFrame, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    return _drain(
        events.sparkSession, "cells",
        lambda path, checkpoint: start_ingest(events, path, checkpoint, trigger=DRAIN, name=_own_name("cells"), mode="cells"),
        "key string, column string, timestamp bigint, cell string", arrivals,
    )


def run_alerts(
    events: DataFrame, cooldown_seconds: int = params.ALERT_COOLDOWN_SECONDS, arrivals: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    return _drain(
        events.sparkSession, "alerts",
        lambda path, checkpoint: start_alerts(events, path, checkpoint, cooldown_seconds, trigger=DRAIN, name=_own_name("alerts")),
        "event_type string, severity string, value double, location string, alert_time timestamp_ntz, event_id string", arrivals,
    )

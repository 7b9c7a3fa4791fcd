"""From landed feed payloads to a topic: every poll is a file, every event is published once.

A poller writes what the feed shows, most of it again and again. The stream parses each file once and keeps the ids it has
published: an id is held for ``horizon`` after the file that brought it arrived, then forgotten. The clock of that state is
the arrival of the files, not the time of the events, so an event that is old when it first shows is published as well,
and the state is bounded by the ids of one horizon. A feed that still shows an id after it publishes that id again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hazardlens import schemas
from hazardlens.sources import feeds, topic
from hazardlens.streaming import jobs, sinks

HORIZON = "7 days"
ARRIVED = "arrived"
_MESSAGES = "key string, value string"


def payload_stream(spark: SparkSession, path: str, one_per_line: bool = False, max_files: int | None = None) -> DataFrame:
    """(value, arrived): the documents of the files that land under ``path``, a file or, ``one_per_line``, a line each."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.text(path, wholetext=not one_per_line).select("value", F.col("_metadata.file_modification_time").alias(ARRIVED))


def feed_events(payloads: DataFrame, schema: StructType, rows: Callable[..., DataFrame], horizon: str = HORIZON) -> DataFrame:
    """Rows of the documents, by a row function of ``sources.feeds``, one for each id that is not held."""
    marked = payloads.withWatermark(ARRIVED, horizon)
    return rows(feeds.decode_payload(marked, schema, keep=(ARRIVED,)), keep=(ARRIVED,)).dropDuplicatesWithinWatermark(["id"])


def quake_events(payloads: DataFrame, horizon: str = HORIZON) -> DataFrame:
    return feed_events(payloads, schemas.GEOJSON, feeds.quake_rows, horizon)


def natural_events(payloads: DataFrame, horizon: str = HORIZON) -> DataFrame:
    return feed_events(payloads, schemas.NATURAL_EVENTS, feeds.natural_event_rows, horizon)


def unreadable(payloads: DataFrame, schema: StructType) -> DataFrame:
    """Documents that cannot be parsed; write them to a side table."""
    return payloads.filter(F.col("value").isNotNull() & F.from_json("value", schema)[schema.names[0]].isNull())


def start_publish(
    events: DataFrame, checkpoint: str, path: str | None = None, servers: str | None = None, to_topic: str | None = None,
    trigger: dict[str, object] | None = None, name: str = "publish", columns: Sequence[str] = (),
) -> StreamingQuery:
    """Messages of the events to a topic, or to a table under ``path`` where a batch that runs again replaces its own rows.

    A topic gets a batch that is repeated after a failure twice, as the connector has no transactions.
    """
    if (path is None) == (servers is None or to_topic is None):
        raise ValueError("publish to a path, or to a topic of servers")
    shown = events.select(*(columns or [c for c in events.columns if c != ARRIVED]))
    messages = topic.to_messages(shown)
    save = sinks.batch_folders(path) if path else lambda batch, _: topic.publish(batch, servers, to_topic)
    return (
        messages.writeStream.queryName(name)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .start()
    )


def run_publish(events: DataFrame, columns: Sequence[str] = (), arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """Publish what has landed, then start anew for each arrival; the table of the messages."""
    def start(path: str, checkpoint: str) -> StreamingQuery:
        return start_publish(events, checkpoint, path, trigger=jobs.DRAIN, name=jobs._own_name("publish"), columns=columns)

    return jobs._drain(events.sparkSession, "publish", start, _MESSAGES, arrivals)

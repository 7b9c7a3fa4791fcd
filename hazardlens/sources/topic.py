"""Topic sources: JSON messages with a broker time, as a stream or as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens import schemas
from hazardlens.functions.numbers import finite
from hazardlens.functions.times import utc_from_text


def topic_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting: str = "earliest",
    max_records: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """A Kafka topic as (value, timestamp); needs the public Kafka connector on the classpath.

    By default everything that the topic holds is read, unthrottled, and lost data is an error;
    ``params.MAX_RECORDS_PER_TRIGGER`` is the intake limit of a small installation.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", str(fail_on_data_loss).lower())
    )
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", str(max_records))
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """The same rows from files that land in a directory, oldest first."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.format(fmt).load(path)


def _decoded(messages: DataFrame, schema: StructType) -> DataFrame:
    """The fields of every message, NULL where they cannot be read; each message is parsed once."""
    data = F.from_json(F.col("value").cast("string"), schema)
    fields = messages.select("value", "timestamp", F.inline(F.array(data)))
    number = {n: F.col(n).try_cast("double") for n in schemas.MESSAGE_NUMBERS if n in schema.names}
    endless = F.lit(False)
    for value in number.values():
        endless = endless | (value.isNotNull() & finite(value).isNull())
    known = {n: finite(value) for n, value in number.items()}
    return fields.withColumns({"time": utc_from_text(F.col("time")), "endless": endless, **known})


def decode_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """Flatten JSON messages, cast leniently, keep the broker time, drop rows without an id.

    Works on batch and streaming input. A field that cannot be read is NULL and does not take
    the other fields with it.
    """
    known = _decoded(messages, schema).filter(F.col("id").isNotNull())
    return known.select(*schema.names, F.col("timestamp").alias("kafka_timestamp"))


def message_rejects(messages: DataFrame, schema: StructType) -> DataFrame:
    """Messages that ``decode_messages`` drops or leaves without a time or a number, with the reason.

    A NaN or infinite number is NULL in the decoded row, which stays, and is listed here.
    """
    reason = (
        F.when(F.col("id").isNull(), "no readable id")
        .when(F.col("time").isNull(), "time unreadable")
        .when(F.col("endless"), "number not finite")
    )
    return _decoded(messages, schema).select("value", "timestamp", reason.alias("reason")).filter("reason IS NOT NULL")


def to_messages(events: DataFrame) -> DataFrame:
    """Rows as JSON messages, one per row, NULL fields kept."""
    return events.select(
        F.col("id").cast("string").alias("key"),
        F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Write messages to a Kafka topic from the executors."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )

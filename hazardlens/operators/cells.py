"""Wide-column rows: one cell per non-NULL field, keyed by row key and qualifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

FAMILY = "info"


def _text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (TimestampType, TimestampNTZType)):
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return F.col(name).cast("string")


def event_cells(events: DataFrame, row_key: str, written_at: Column, fields=None) -> DataFrame:
    """Cells (row_key, family, qualifier, ts, value); ``written_at`` is in epoch milliseconds.

    A narrow transformation: the fields of a row become an inline array, NULL values go.
    """
    names = fields or [c for c in events.columns if c != row_key]
    cells = F.array(*[F.struct(F.lit(n).alias("qualifier"), _text(events, n).alias("value")) for n in names])
    return (
        events.select(F.col(row_key).cast("string").alias("row_key"), written_at.alias("ts"), F.inline(cells))
        .filter(F.col("value").isNotNull())
        .select("row_key", F.lit(FAMILY).alias("family"), "qualifier", "ts", "value")
    )


def encode_cells(cells: DataFrame) -> DataFrame:
    """The stored form: row key, column name and value in base64, times in milliseconds."""
    column = F.concat_ws(":", "family", "qualifier")
    return cells.select(
        F.base64(F.encode("row_key", "UTF-8")).alias("key"),
        F.base64(F.encode(column, "UTF-8")).alias("column"),
        F.col("ts").alias("timestamp"),
        F.base64(F.encode("value", "UTF-8")).alias("cell"),
    )


def latest_cells(cells: DataFrame) -> DataFrame:
    """The newest cell per row key and column; a replayed write changes nothing."""
    newest = F.max(F.struct("ts", "value")).alias("newest")
    return (
        cells.groupBy("row_key", "family", "qualifier")
        .agg(newest)
        .select("row_key", "family", "qualifier", "newest.ts", "newest.value")
    )


def rowkey_struct(events: DataFrame, key: str = "id") -> DataFrame:
    """A row key beside one struct of the family name and all columns."""
    return events.select(F.col(key).alias("rowkey"), F.struct(F.lit(FAMILY).alias("cf"), *events.columns).alias("data"))

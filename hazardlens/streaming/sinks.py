"""Stream sinks: replay-safe batch folders, console, JSON, parquet, wide-column cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hazardlens.operators import cells

CONSOLE_ROWS = 20
OUTPUT_MODES = ("console", "json", "parquet", "cells")


def batch_folders(path: str, shape: Callable[[DataFrame], DataFrame] | None = None, by: tuple[str, ...] = ()):
    """A foreachBatch function that writes replay-safe parquet: a batch overwrites its own folders and no others.

    With ``by`` the table is laid out by these columns first and by batch_id below them, so filters on them prune; see
    ``compact``. Without, each batch is a folder. One distributed write per batch; no count and no rows on the driver.
    A ``shape`` may read the batch more than once, so the batch is kept while it is written and its stateful steps run once.
    """
    def save(out: DataFrame, batch_id: int) -> None:
        if by:
            numbered = out.withColumn("batch_id", F.lit(batch_id))
            writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(*by, "batch_id").parquet(path)
        else:
            out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        if shape is None:
            save(batch, batch_id)
            return
        kept = batch.persist()
        try:
            save(shape(kept), batch_id)
        finally:
            kept.unpersist()

    return write


def compact(spark, source: str, target: str, by: tuple[str, ...], files: str = "rebalance") -> None:
    """A streamed table rewritten with few files per folder and without batch numbers, as another table.

    The source is only read, so readers and a running stream are not disturbed; run it on folders that are complete.
    """
    rows = spark.read.parquet(source).drop("batch_id").hint(files, *by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(target)


def as_cells(batch: DataFrame, key: Column, moment: Column) -> DataFrame:
    """Stored cells of a batch, stamped with ``moment``, which a replay does not change."""
    keyed = batch.withColumn("_row_key", key)
    return cells.encode_cells(cells.event_cells(keyed, "_row_key", F.unix_millis(moment.cast("timestamp")), fields=[c for c in batch.columns if c != "id"]))


def deliver(path: str | None, mode: str, key: Column, moment: Column, by: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """Write one batch in an output mode, for queries whose steps need the batch as a table."""
    check(mode, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "console":
            batch.show(CONSOLE_ROWS, truncate=False)
        elif mode == "json":
            batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")
        elif mode == "cells":
            batch_folders(path)(as_cells(batch, key, moment), batch_id)
        else:
            batch_folders(path, by=by)(batch, batch_id)

    return write


def check(mode: str, path: str | None) -> None:
    if mode not in OUTPUT_MODES:
        raise ValueError(f"unknown output mode {mode!r}, one of {OUTPUT_MODES}")
    if mode != "console" and path is None:
        raise ValueError(f"output mode {mode!r} needs a path")


def writer(
    stream: DataFrame, mode: str, path: str | None, checkpoint: str, name: str, trigger: dict[str, object],
    key: Column | None = None, moment: Column | None = None,
) -> DataStreamWriter:
    """One sink per query, chosen by the output mode; cells need a row key and a moment."""
    check(mode, path)
    out = (
        stream.writeStream.outputMode("append")
        .queryName(name)
        .trigger(**trigger)
        .option("checkpointLocation", checkpoint)
    )
    if mode == "console":
        return out.format("console").option("truncate", "false").option("numRows", CONSOLE_ROWS)
    if mode == "cells":
        if key is None or moment is None:
            raise ValueError("cells need a row key and a moment")
        return out.foreachBatch(deliver(path, mode, key, moment))
    return out.format(mode).option("path", path)


def finish(query: StreamingQuery) -> None:
    """Wait for a query that ends by itself and raise its error if it failed."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

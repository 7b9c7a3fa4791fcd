"""Loads that happen once: a table of loads beside a ledger that says which of them count and where the next one starts.

A load is one set of landed files to one folder of rows, ``rows/load_id=...``. Its last step is its row in the ledger,
``ledger/load_id=...``: the highest arrival it read, the high-water mark of its rows, how many rows and files they are. Spark
makes a folder's files visible together, when the write is committed, so:

* a load that ended before its ledger row is as if it had not been: nothing reads its rows, and its next run overwrites them;
* a load whose row is in the ledger is not run again;
* the next load reads only landing folders behind the highest arrival of the ledger, which a partition filter leaves to
  the file index, and takes of their rows those at or behind the mark whose id no counted load has.

Landing folders are ``arrived=<text>`` in an order that texts sort in, and complete when a load reads them. There is one loader
at a time. What comes to the driver are three values of the ledger, one row in all, and the ids of the loads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens.sources import feeds

LEDGER = "load_id string, arrived string, mark timestamp_ntz, row_count bigint, file_count bigint"
ARRIVED = "arrived"


@dataclass(frozen=True)
class LoadTable:
    """The table of loads under ``folder``, of rows with ``schema``; ``key`` says which rows are the same, ``time`` is what the
    mark is taken of. Rows without a time are taken from every new landing folder."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: str = "id"
    time: str = "last_modified"
    #: Whether rows before the mark count as loaded, as in feeds that list changes in order.
    from_mark: bool = True

    def _read(self, name: str, schema, path: str = "") -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}{path}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The loads that count, one row each."""
        return self._read("ledger", LEDGER)

    def rows(self) -> DataFrame:
        """The rows of the loads that count, with ``load_id``; folders of other loads are not listed for reading."""
        own = StructType([*self.schema.fields]).add("load_id", "string")
        counted = [r["load_id"] for r in self.ledger().select("load_id").toLocalIterator()]
        rows = self._read("rows", own)
        return rows.filter(F.col("load_id").isin(counted)) if counted else rows.filter(F.lit(False))

    def load(self, load_id: str, landed: DataFrame, decode: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] = lambda: None) -> bool:
        """Take what has landed since the last load; False, and nothing done, if ``load_id`` counts already.

        ``landed`` has the landing column ``arrived`` and what ``decode`` makes rows from. ``before_commit`` runs between the rows
        and the ledger row, where a check of the rows can still refuse them by raising.
        """
        last = self.ledger().agg(F.max("arrived").alias("arrived"), F.max("mark").alias("mark"), F.count_if(F.col("load_id") == load_id).alias("same")).first()
        if last["same"]:
            return False
        new = landed if last["arrived"] is None else landed.filter(F.col(ARRIVED) > last["arrived"])
        incoming = decode(new)
        if self.from_mark and last["mark"] is not None:
            incoming = feeds.since(incoming, F.lit(last["mark"]).cast("timestamp_ntz"), self.time)
        fresh = feeds.new_rows_only(incoming.select(*self.schema.names), self.rows(), self.key)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/rows/load_id={load_id}")
        before_commit()
        written = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/load_id={load_id}")
        sums = written.agg(F.max(self.time).alias("mark"), F.count("*").alias("row_count"))
        files = new.select(ARRIVED, F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.max(ARRIVED).alias(ARRIVED))
        none = F.lit(None)
        read = files.agg(F.max(ARRIVED).alias("arrived"), none.cast("timestamp_ntz").alias("mark"), F.lit(0).alias("row_count"), F.count("*").alias("file_count"))
        kept = sums.select(none.cast("string").alias("arrived"), "mark", "row_count", F.lit(0).alias("file_count"))
        known = F.lit(last["arrived"]).cast("string"), F.lit(last["mark"]).cast("timestamp_ntz")
        entry = read.unionByName(kept).agg(
            F.greatest(F.max("arrived"), known[0]).alias("arrived"), F.greatest(F.max("mark"), known[1]).alias("mark"),
            F.sum("row_count").alias("row_count"), F.sum("file_count").alias("file_count"),
        )
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/load_id={load_id}")
        return True

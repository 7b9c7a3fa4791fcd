"""A stored table of current cells that is merged by copy-on-write.

Rows of one row key lie in one slot, a partition, and there in buckets by cell. A merge reads the slots that its cells fall
in, joins them with the new cells bucket by bucket, so that only the new side is shuffled, and writes these slots anew into a
folder of its own, a generation. Slots it does not touch are neither read nor written. Its last step is its row in the log,
which says which slots it has replaced; until then readers see the table as it was, and a merge that ended early is
as if it had not been. A merge that is in the log already does nothing, so a batch that is repeated changes nothing.

The log has one row for each merge; what comes to the driver are the generations of the slots, at most ``slots`` rows. There
is one writer at a time. Generations that no slot is in any more stay on disk; ``stale`` lists them for removal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.operators.cells import latest_cells

KEYS = ["row_key", "family", "qualifier"]
_CELLS = "row_key string, family string, qualifier string, ts bigint, value string"
_LOG = "merge_id string, seq int, slots array<int>"


@dataclass(frozen=True)
class CellTable:
    """The table under ``folder``; ``slots`` and ``buckets`` are fixed when it is begun."""

    spark: SparkSession
    folder: str
    slots: int = 32
    buckets: int = 8

    def slot(self) -> Column:
        return F.pmod(F.xxhash64("row_key"), F.lit(self.slots)).cast("int")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def generations(self) -> dict[int, str]:
        """The folder of each slot that has cells."""
        newest = self.log().select("merge_id", "seq", F.explode("slots").alias("slot")).groupBy("slot").agg(F.max_by("merge_id", "seq").alias("merge_id"))
        return {r["slot"]: f"{self.folder}/generation={r['merge_id']}/slot={r['slot']}" for r in newest.collect()}

    def _stored(self, slots: dict[int, str], name: str) -> DataFrame:
        """The cells of some slots, with Spark knowing their buckets: a table of partitions, each in its own folder."""
        self.spark.sql(
            f"CREATE TABLE {name} ({_CELLS}, slot int) USING parquet PARTITIONED BY (slot) "
            f"CLUSTERED BY ({', '.join(KEYS)}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/none'"
        )
        if slots:
            places = " ".join(f"PARTITION (slot={s}) LOCATION '{path}'" for s, path in slots.items())
            self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        return self.spark.table(name)

    def read(self) -> DataFrame:
        """The current cells."""
        paths = self.generations()
        if not paths:
            return self.spark.createDataFrame([], _CELLS)
        return self.spark.read.schema(_CELLS).parquet(*paths.values())

    def merged(self, cells: DataFrame, touched: dict[int, str], name: str) -> DataFrame:
        """The stored cells of the touched slots, under a table name, with the new ones: of each cell the newest, then the
        greatest value."""
        new = latest_cells(cells).select(*KEYS, F.struct("ts", "value").alias("new"), self.slot().alias("new_slot"))
        old = self._stored(touched, name).select(*KEYS, F.struct("ts", "value").alias("old"), "slot")
        both = old.join(new, KEYS, "full_outer")
        return both.select(*KEYS, F.greatest("old", "new").alias("cell"), F.coalesce("slot", "new_slot").alias("slot")).select(*KEYS, "cell.ts", "cell.value", "slot")

    def merge(self, merge_id: str, cells: DataFrame, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Take in cells (row_key, family, qualifier, ts, value); False, and nothing done, if ``merge_id`` is in already.

        ``before_commit`` runs between the cells and the log row and can still refuse the merge by raising.
        """
        state = self.log().agg(F.count_if(F.col("merge_id") == merge_id).alias("same"), F.max("seq").alias("seq")).first()
        if state["same"]:
            return False
        touched = sorted(r["slot"] for r in cells.select(self.slot().alias("slot")).distinct().collect())
        paths = self.generations()
        names = [f"{what}_{uuid.uuid4().hex}" for what in ("stored", "merged")]
        try:
            out = self.merged(cells, {s: paths[s] for s in touched if s in paths}, names[0])
            writer = out.write.mode("overwrite").format("parquet").partitionBy("slot").bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
            writer.option("path", f"{self.folder}/generation={merge_id}").saveAsTable(names[1])
        finally:
            for name in names:  # only the names: the folders are not the catalog's
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        before_commit()
        entry = self.spark.createDataFrame([(merge_id, (state["seq"] or 0) + 1, touched)], _LOG)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/entry={merge_id}")
        return True

    def stale(self) -> list[str]:
        """Slot folders of merges in the log that later merges have replaced."""
        every = self.log().select("merge_id", F.explode("slots").alias("slot")).toLocalIterator()
        return sorted({f"{self.folder}/generation={r['merge_id']}/slot={r['slot']}" for r in every} - set(self.generations().values()))

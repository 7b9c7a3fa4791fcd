"""A listing stored in its order, so that any page of it is found without sorting or passing over what comes before.

The rows are dealt to parts by ranges of the order and sorted within them, each part a folder. ``ranks`` says at which row
each part begins and is written last. A page reads the parts that its rows lie in, one or two of them unless pages are
larger than parts, and orders those alone. What comes to the driver are the parts of one page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

_RANKS = "part int, first_row bigint, row_count bigint"
PART = "_part"


def _order(by: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{n}`").desc_nulls_last() if d else F.col(f"`{n}`").asc_nulls_last() for n, d in by]


@dataclass(frozen=True)
class RankedListing:
    """Rows with ``schema`` stored under ``folder`` in the order ``by`` of (column, descending), NULL last."""

    spark: SparkSession
    folder: str
    schema: StructType
    by: tuple[tuple[str, bool], ...]

    @classmethod
    def build(cls, rows: DataFrame, folder: str, by: Sequence[tuple[str, bool]], parts: int = 200) -> RankedListing:
        """Store the rows. The order should be total: where rows tie, their order is not defined and they share a part."""
        spark, order = rows.sparkSession, _order(by)
        dealt = rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
        dealt.sortWithinPartitions(PART, *order).write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/rows")
        own = cls(spark, folder, rows.schema, tuple(by))
        counts = own._rows().groupBy(F.col(PART).alias("part")).agg(F.count("*").alias("row_count"))
        before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
        ranks = counts.select("part", F.coalesce(F.sum("row_count").over(before), F.lit(0)).alias("first_row"), "row_count")
        ranks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
        return own

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(PART, IntegerType())).parquet(f"{self.folder}/rows")

    def ranks(self) -> DataFrame:
        return self.spark.read.schema(_RANKS).parquet(f"{self.folder}/ranks")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) with the columns total_results, from_row and to_row; empty behind the last row."""
        if number < 1 or size < 1:
            raise ValueError("pages and their size count from 1")
        skip = (number - 1) * size
        begins, ends = F.col("first_row"), F.col("first_row") + F.col("row_count")
        ranks = self.ranks().withColumn("total", F.sum("row_count").over(Window.partitionBy()))
        found = ranks.filter((begins < skip + size) & (ends > skip)).orderBy("part").collect()
        total = found[0]["total"] if found else 0
        rows = self._rows().filter(F.col(PART).isin([r["part"] for r in found])).drop(PART) if found else self._rows().filter(F.lit(False)).drop(PART)
        shown = rows.orderBy(*_order(self.by)).offset(skip - (found[0]["first_row"] if found else 0)).limit(size)
        last = F.lit(min(skip + size, total)).cast("bigint")
        return shown.withColumns({"total_results": F.lit(total).cast("bigint"), "from_row": F.lit(skip + 1).cast("bigint"), "to_row": last})

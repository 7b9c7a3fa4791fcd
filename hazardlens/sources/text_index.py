"""A stored table whose texts can be searched for a part of them without reading all of it.

The rows are dealt to blocks by ranges of their texts, each block a folder, so that like texts lie together. An inverted table
says which three characters in a row stand in which block, for each text column; it is partitioned by a hash of the three
characters. A search looks up those of the wanted text, keeps the blocks that hold all of them in one column, reads these
blocks and compares their rows, so the result is that of the full scan. A wanted text of under three characters reads
every block. What comes to the driver are the numbers of the blocks that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from hazardlens.operators.events import text_match

BLOCK = "_block"
WIDTH = 3
_GRAMS = "source string, gram string, block int, slot int"
SLOTS = 64


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    n = F.length(low) - F.lit(WIDTH - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, F.lit(WIDTH)))))


@dataclass(frozen=True)
class TextIndex:
    """Rows with ``schema`` under ``folder``, searchable in ``columns``."""

    spark: SparkSession
    folder: str
    schema: StructType
    columns: tuple[str, ...]

    @classmethod
    def build(cls, rows: DataFrame, folder: str, columns: tuple[str, ...], blocks: int = 200) -> TextIndex:
        """Store the rows and, last, the inverted table; ``columns`` have to be text."""
        own = cls(rows.sparkSession, folder, rows.schema, columns)
        order = [F.col(c) for c in columns]
        dealt = rows.repartitionByRange(blocks, *order, F.xxhash64(*rows.columns)).withColumn(BLOCK, F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy(BLOCK).parquet(f"{folder}/rows")
        each = F.array(*[F.struct(F.lit(c).alias("source"), grams(F.col(c)).alias("of")) for c in columns])
        listed = own._rows().select(F.inline(each), BLOCK).select("source", F.explode("of").alias("gram"), F.col(BLOCK).alias("block"))
        inverted = listed.distinct().withColumn("slot", _slot(F.col("gram")))
        inverted.repartition(SLOTS, "slot").sortWithinPartitions("slot", "gram").write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/grams")
        return own

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BLOCK, IntegerType())).parquet(f"{self.folder}/rows")

    def blocks(self, query: str) -> list[int] | None:
        """The blocks that can hold the wanted text; None where it is too short to tell."""
        low = query.lower()
        wanted = sorted({low[i : i + WIDTH] for i in range(len(low) - WIDTH + 1)})
        if not wanted:
            return None
        slots = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(_slot(F.col("gram")).alias("slot")).distinct().collect()
        inverted = self.spark.read.schema(_GRAMS).parquet(f"{self.folder}/grams")
        met = inverted.filter(F.col("slot").isin([r["slot"] for r in slots]) & F.col("gram").isin(wanted))
        full = met.groupBy("source", "block").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
        return sorted(r["block"] for r in full.select("block").distinct().collect())

    def search(self, query: str) -> DataFrame:
        """The rows with the wanted text in one of the columns, in either case; all rows for an empty one."""
        if not query:
            return self._rows().drop(BLOCK)
        left = self.blocks(query)
        rows = self._rows() if left is None else self._rows().filter(F.col(BLOCK).isin(left) if left else F.lit(False))
        return rows.filter(text_match(query, *self.columns)).drop(BLOCK)

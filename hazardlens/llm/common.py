"""Written intermediates, membership bitmaps and connected components."""

from __future__ import annotations

import gc
import math

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.sources.tables import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now; it only learns of them when the driver collects
    its garbage, in Python first, as frames there hold the plans of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: computed once, lost with no executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Members:
    """A bitmap over hashed keys: no member is missed, a few others pass. At most 32 MB."""

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False, most_bits: int = 28):
        """``hashed``: the keys are hashes already, so their low bits are the cell."""
        self.bits = min(most_bits, max(15, math.ceil(math.log2(max(1, 16 * keys.count())))))
        self.column, self.hashed = column, hashed
        cells = keys.select(self.cell().alias("cell"))
        maps = cells.groupBy(F.shiftright("cell", 15).alias("bucket")).agg(
            F.bitmap_construct_agg(F.col("cell").bitwiseAND(32767)).alias("map")
        )
        self.map = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in maps.toLocalIterator():
            self.map[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(r["map"], np.uint8)

    def cell(self):
        """The cell of a key, as a column."""
        own = F.col(self.column) if self.hashed else F.xxhash64(self.column)
        return own.bitwiseAND(F.lit((1 << self.bits) - 1))


def has_bit(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node that it reaches.

    Alternating large-star and small-star steps, each a running minimum per node, so a hub's
    edges stream through a sort and are never held together. Rounds grow with the logarithm of the size.
    A round deals its edges out three times: by node for each step, and once more to make them distinct.
    """
    star = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    by_least = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    before = None
    while True:
        both = star.union(star.select("b", "a"))
        least = F.least(F.first("b").over(by_least), F.col("a"))
        large = both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).repartition("a").distinct()
        small = large.withColumn("m", F.first("b").over(by_least))
        own, linked = (F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("a", "b"))
        pairs = small.select(F.explode(F.when(F.col("b") != F.col("m"), F.array(own, linked)).otherwise(F.array(own))).alias("e"))
        seen = Observation()
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        star = written(pairs.select("e.*").distinct().observe(seen, F.count("*").alias("edges"), total.alias("total")), "edges")
        now = seen.get
        if now == before:
            break
        before = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())

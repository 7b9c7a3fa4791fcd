"""Keeping a hot key from becoming one long task.

Spark splits skewed partitions of most joins at run time. What it cannot split is a join whose other side, or whose
output, is the problem: pair joins inside a crowded bucket, and outer joins with the crowded side kept. A key is hot
when it holds more than ``TASKS`` times the rows of an average task; it is then cut into as many parts as it would fill average
tasks. Both numbers follow from the data and the shuffle partitions, and there are fewer hot keys than partitions,
so the list of hot keys is the one thing here that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS = 4


def hot_keys(counted: DataFrame, keys: Sequence[str], rows: str = "rows", tasks: int = TASKS, partitions: int | None = None) -> DataFrame:
    """(keys, splits) of a pre-aggregated (keys, rows) table: the keys that would be more than ``tasks`` average tasks."""
    partitions = partitions or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum(rows).alias("total")).scalar()
    splits = F.ceil(F.col(rows) * F.lit(partitions) / total).cast("int")
    return counted.select(*keys, splits.alias("splits")).filter(F.col("splits") > tasks)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Equi join in which the left rows of a hot key spread over its splits.

    The right rows of hot keys are repeated once per split, all others are used as they are. Left rows with a NULL key
    match nothing, so they spread as well instead of meeting in one task. The salt is a hash of the row, so a task that
    runs again deals its rows as before.
    """
    flag = F.broadcast(hot.select(*keys, F.col("splits").alias("_splits")))
    spread = F.abs(F.xxhash64(*left.columns) % F.lit(1 << 20)).cast("int")
    unmatched = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.when(unmatched, spread).otherwise(spread % F.coalesce("_splits", F.lit(1)))
    l = left.join(flag, list(keys), "left").withColumn("_salt", salt)
    every = F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)
    r = right.join(flag, list(keys), "left").withColumn("_salt", F.explode(every))
    return l.drop("_splits").join(r.drop("_splits"), [*keys, "_salt"], how).drop("_salt")

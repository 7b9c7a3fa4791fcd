"""Stored event tables and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Store events by type and event date so that both prune on read.

    One type may hold most of the rows, so nothing is shuffled by type here: each task writes
    its own files and AQE's rebalance splits what is large.
    """
    dated = events.withColumn("event_date", F.to_date("time")).hint("rebalance", "type", "event_date")
    dated.write.mode(mode).partitionBy("type", "event_date").parquet(path)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="hazardlens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only a local session without that setting, such as a test's, gets a temporary folder of this machine; one for the
    process, removed when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Alert cooldown over stored events.

The rule is sequential: after an alert of a key, the next one is its first candidate at least
``cooldown`` seconds later. There are only a handful of keys, so a key must not become a task.
Instead the time of a key is cut into day blocks and solved in three steps:

1. per (key, block): a step function from "earliest allowed second" on entering the block to the
   earliest allowed second on leaving it. It needs no knowledge of earlier blocks.
2. per key: chain the step functions, a few rows per block, to get the entry state of each block.
3. per (key, block): with its entry state known, list the seconds that fire.

Candidates are first combined to one row per key and second, so a block has at most
``BLOCK_SECONDS`` rows however many events there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SECONDS = 86_400
NEVER = -(2**62)


def combine_seconds(candidates: DataFrame) -> DataFrame:
    """One candidate per key and second: the largest value, then the smallest id."""
    rest = [c for c in candidates.columns if c not in ("alert_key", "time")]
    best = F.min(F.struct((-F.col("value")).alias("_rank"), "event_id", F.struct(*rest).alias("row")))
    return (
        candidates.withColumn("second", F.date_trunc("second", "time").cast("timestamp_ntz"))
        .groupBy("alert_key", "second")
        .agg(best.alias("best"))
        .select("alert_key", "second", "best.row.*")
    )


def block_steps(seconds: np.ndarray, block_start: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one block: entering with allowed <= upto[i] leaves with leave[i]."""
    n = len(seconds)
    last = np.searchsorted(seconds, seconds + cooldown)
    last = np.where(last < n, last, np.arange(n))
    while True:
        hop = last[last]
        if np.array_equal(hop, last):
            break
        last = hop
    # A state carried into the block is below block_start + cooldown.
    reachable = min(n, int(np.searchsorted(seconds, block_start + cooldown)) + 1)
    upto, leave = seconds[:reachable], (seconds[last] + cooldown)[:reachable]
    keep = np.append(leave[1:] != leave[:-1], True)
    return upto[keep], leave[keep]


def fire_block(seconds: np.ndarray, allowed: int, cooldown: int) -> np.ndarray:
    fired = []
    i = int(np.searchsorted(seconds, allowed))
    while i < len(seconds):
        fired.append(i)
        i = int(np.searchsorted(seconds, seconds[i] + cooldown))
    return seconds[fired]


def apply(candidates: DataFrame, cooldown: int, block: int = BLOCK_SECONDS, entry: DataFrame | None = None) -> DataFrame:
    """Candidates that fire under the cooldown, one row per (alert_key, second).

    ``entry`` (alert_key, allowed) gives keys the epoch second before which they may not fire. A cooldown of 0 lets
    every second fire, as one of 1 does; a negative one is an error.
    """
    if cooldown < 0:
        raise ValueError("a cooldown cannot be negative")
    cooldown = max(1, cooldown)
    block = max(block, cooldown)
    combined = combine_seconds(candidates)
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', second)")
    blocked = (
        combined.select("alert_key", epoch.alias("s"))
        .withColumn("block", F.floor(F.col("s") / F.lit(block)))
        .groupBy("alert_key", "block")
    )

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        upto, leave = block_steps(np.sort(pdf["s"].to_numpy()), int(key[1]) * block, cooldown)
        return pd.DataFrame({"alert_key": key[0], "block": key[1], "upto": upto, "leave": leave})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current, entered, allowed, done = None, None, NEVER, NEVER, False
        for pdf in batches:
            out = []
            for k, b, upto, leave in zip(pdf["alert_key"], pdf["block"], pdf["upto"], pdf["leave"]):
                if k != key:
                    key, current, allowed = k, None, NEVER
                if b != current:
                    current, entered, done = b, allowed, False
                    out.append((k, b, entered))
                if not done and entered <= upto:
                    allowed, done = leave, True
            yield pd.DataFrame(out, columns=["alert_key", "block", "allowed"])

    def fire(key: tuple, seconds: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        fired = fire_block(np.sort(seconds["s"].to_numpy()), int(entry["allowed"].iloc[0]), cooldown)
        return pd.DataFrame({"alert_key": key[0], "s": fired})

    solved = blocked.applyInPandas(steps, "alert_key string, block bigint, upto bigint, leave bigint")
    if entry is not None:  # as a block before all others that every state leaves with what is allowed
        solved = solved.union(entry.select("alert_key", F.lit(NEVER), F.lit(-NEVER), "allowed"))
    entries = (
        solved.repartition("alert_key")
        .sortWithinPartitions("alert_key", "block", "upto")
        .mapInPandas(chain, "alert_key string, block bigint, allowed bigint")
    )
    fired = blocked.cogroup(entries.groupBy("alert_key", "block")).applyInPandas(fire, "alert_key string, s bigint")
    moment = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))
    return combined.join(fired.select("alert_key", moment.alias("second")), ["alert_key", "second"], "left_semi")

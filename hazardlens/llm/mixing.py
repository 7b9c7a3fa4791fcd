"""Mixing sources to target weights by Pfair scheduling.

A source with weight w of a total W has the k-th of its blocks (k from 1) released at floor((k - 1) W / w) and due at
ceil(k W / w); in each slot the released block with the earliest deadline runs. With unit slots and full use this
meets every deadline, so in every prefix each source is less than one block from its share. The schedule repeats
after W slots, so only one period is scheduled, on the driver, from the weights alone; every block then finds its slot by
arithmetic in parallel. When a source has no block left the others go on at their own weights: a new phase.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 32
BUCKET_ROWS = 1 << 12
MAX_PERIOD = 10_000
OTHER = "*"


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period of sum(weights) slots, earliest deadline first.

    Equal deadlines go to the source whose name is smaller.
    """
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    later = [(0, s) for s in sorted(weights)]  # by release
    ready: list[tuple[int, str]] = []
    heapq.heapify(later)
    for t in range(total):
        while later and later[0][0] <= t:
            _, s = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(later, (len(slots[s]) * total // weights[s], s))
    return slots


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """The phases of a mix: their first slot, and for each live source the blocks before it, its own and its slots."""
    done = dict.fromkeys(weights, 0)
    out, base = [], 0
    while live := {s: w for s, w in weights.items() if blocks.get(s, 0) > done[s]}:
        total, slots = sum(live.values()), period(live)
        last = {s: (blocks[s] - done[s] - 1) // w * total + slots[s][(blocks[s] - done[s] - 1) % w] for s, w in live.items()}
        end = min(last.values()) + 1
        share = {}
        for s, w in live.items():
            share[s] = end // total * w + sum(x < end % total for x in slots[s])
        out.append({"base": base, "total": total, "weights": live, "slots": slots, "before": {s: done[s] for s in live}, "share": share})
        for s in live:
            done[s] += share[s]
        base += end
    return out


def mix(docs: DataFrame, weights: Mapping[str, int], block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """The columns ``keep`` with mix_source, block, place, release, deadline, slot and position; every row once.

    ``weights`` maps sources to positive integers, at most ``MAX_PERIOD`` together; '*' stands for all other sources
    and null. Without '*' other sources share a weight of 1. A block is ``block_rows`` rows of one source (its last
    may have fewer), ``place`` the row's place in it; release, deadline and slot count blocks from the start of the
    row's phase, ``slot`` from the start of the mix. ``position`` orders all rows: slot, then place. Rows are numbered
    inside a source by a hash of the columns ``keep``, then those columns. No rows give no rows.
    """
    if any(w < 1 for w in weights.values()) or sum(weights.values()) > MAX_PERIOD:
        raise ValueError(f"weights must be positive and at most {MAX_PERIOD} together")
    weights = {OTHER: 1, **weights}
    named = [s for s in weights if s != OTHER]
    source = F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], source.alias("mix_source"), F.xxhash64(*keep).alias("spread"))
    sizes = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.count("*").alias("n")).collect()}
    # at most one row per weight: the number of weights bounds what is collected here and below
    plan = phases(weights, {s: -(-n // block_rows) for s, n in sizes.items()})
    if not plan:
        longs = ("block", "place", "release", "deadline", "slot", "position")
        return rows.select(*[F.col(f"in_{c}").alias(c) for c in keep], "mix_source", *[F.lit(None).cast("long").alias(c) for c in longs])

    buckets = _lookup(F.col("mix_source"), {s: -(-n // BUCKET_ROWS) for s, n in sizes.items()})
    rows = rows.withColumn("bucket", F.pmod("spread", buckets))
    held = rows.groupBy("mix_source", "bucket").agg(F.count("*").alias("n"))
    ahead = held.withColumn("ahead", F.sum("n").over(Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("mix_source", "bucket").orderBy("spread", *[f"in_{c}" for c in keep])) - 1
    rows = rows.withColumn("rank", rank).join(ahead, ["mix_source", "bucket"]).withColumn("number", F.col("ahead") + F.col("rank"))
    rows = rows.withColumns({"block": F.floor(F.col("number") / block_rows), "place": F.pmod("number", F.lit(block_rows))})

    table = [
        (s, p["before"][s], p["before"][s] + p["share"][s], p["base"], p["total"], p["weights"][s], p["slots"][s])
        for p in plan for s in p["weights"] if p["share"][s]
    ]
    lookup = docs.sparkSession.createDataFrame(table, "mix_source string, low long, high long, base long, total long, weight long, slots array<long>")
    at = F.col("block") - F.col("low")
    slot = F.col("base") + F.floor(at / F.col("weight")) * F.col("total") + F.element_at("slots", (F.pmod(at, F.col("weight")) + 1).cast("int"))
    placed = rows.join(F.broadcast(lookup), "mix_source").filter("block >= low and block < high").withColumns(
        {"release": F.floor(at * F.col("total") / F.col("weight")), "deadline": F.ceil((at + 1) * F.col("total") / F.col("weight")), "slot": slot}
    )
    # only a source's last block can be short; each lies in a known slot, so what it lacks moves all rows behind it
    lack = sorted(
        (next(p["base"] + (b - p["before"][s]) // p["weights"][s] * p["total"] + p["slots"][s][(b - p["before"][s]) % p["weights"][s]]
              for p in plan if s in p["weights"] and p["before"][s] <= b < p["before"][s] + p["share"][s]), block_rows - (n - b * block_rows))
        for s, n in sizes.items() for b in [(n - 1) // block_rows]
    )
    missing = reduce(lambda c, x: c + F.when(F.col("slot") > x[0], F.lit(x[1])).otherwise(F.lit(0)), lack, F.lit(0).cast("long"))
    position = F.col("slot") * block_rows + F.col("place") - missing
    return placed.select(
        *[F.col(f"in_{c}").alias(c) for c in keep], "mix_source", "block", F.col("place").cast("long").alias("place"),
        "release", "deadline", "slot", position.alias("position"),
    )


def _lookup(key: Column, values: Mapping[str, int]) -> Column:
    return reduce(lambda c, kv: F.when(key == kv[0], F.lit(kv[1]).cast("long")).otherwise(c), values.items(), F.lit(1).cast("long"))

"""Count-min sketches over 64-bit hashes, merged from the sketches of partitions.

Each row of the sketch maps a hash to one of 2**bits cells. A task counts its own hashes and sends the occupied cells
of each shard of cells as packed gaps; one merge per shard adds them and answers, per threshold, one bit a cell.
A count is never underestimated, so ``levels`` may call a rare hash frequent, never the other way round.
The merged planes are what is broadcast: depth * thresholds * 2**bits / 8 bytes, with bits at most ``MAX_BITS``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazardlens.llm.common import release
from hazardlens.llm.kernel import U, pack_gaps, unpack_gaps

MAX_BITS = 28
SHARD_BITS = 22
FLUSH = 1 << 20
_ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def bits_for(items: int, most: int = MAX_BITS) -> int:
    """Bits of a row of at least two cells an item, between 2**16 and 2**most cells."""
    return min(most, max(16, math.ceil(math.log2(max(1, 2 * items)))))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * U(_ROWS[row])) >> U(64 - bits)


@dataclass
class Sketch:
    """Merged planes: planes[row][threshold] is a bitmap over the cells of the row."""

    bits: int
    planes: list[list[np.ndarray]]

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """How many thresholds the estimated count of each hash reaches."""
        out = None
        for row, planes in enumerate(self.planes):
            cell = _cells(hashes, row, self.bits).astype(np.int64)
            byte, bit = cell >> 3, (cell & 7).astype(np.uint8)
            here = sum(((plane[byte] >> bit) & 1) for plane in planes)
            out = here if out is None else np.minimum(out, here)
        return out

    def reaching(self, hashes: np.ndarray, threshold: int = 0) -> np.ndarray:
        """Places of the hashes whose estimated count reaches a threshold; each row looks only at what the others left."""
        at = None
        for row, planes in enumerate(self.planes):
            cell = _cells(hashes if at is None else hashes[at], row, self.bits).astype(np.int64)
            hit = np.flatnonzero((planes[threshold][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at


def build(
    rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int,
    thresholds: Sequence[int] = (2,), depth: int = 2,
) -> Sketch:
    """The sketch of all hashes that ``hashes`` yields for the batches of ``rows``."""
    shard_bits = min(SHARD_BITS, bits)
    shards, cap = 1 << (bits - shard_bits), max(thresholds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            for row in range(depth):
                cells = np.sort(_cells(every, row, bits)).astype(np.int64)
                if len(cells) > cap:  # a cell is listed as often as it counts, cap times at most
                    cells = cells[np.concatenate([np.ones(cap, bool), cells[cap:] != cells[:-cap]])]
                cuts = np.searchsorted(cells, np.arange(shards + 1) << shard_bits)
                ids, packed = [], []
                for s in range(shards):
                    if cuts[s] < cuts[s + 1]:
                        ids.append(row * shards + s)
                        packed.append(pack_gaps(cells[cuts[s] : cuts[s + 1]] - (s << shard_bits)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["shard", "cells"])

        for batch in batches:
            for some in hashes(batch):
                held.append(some)
                size += len(some)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = unpack_gaps(packed.as_buffer())
                own = counts.setdefault(shard, np.zeros(1 << shard_bits, np.uint8))
                first = np.flatnonzero(np.diff(cells, prepend=-1))
                times = np.diff(first, append=len(cells))
                own[cells[first]] = np.minimum(own[cells[first]].astype(np.int64) + times, cap)
        for shard, own in counts.items():
            planes = [np.packbits(own >= t, bitorder="little").tobytes() for t in thresholds]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([planes], pa.list_(pa.binary()))], ["shard", "planes"])

    parts = rows.mapInArrow(count, "shard int, cells binary").repartition(depth * shards, "shard")
    sketch = Sketch(bits, [[np.zeros(1 << (bits - 3), np.uint8) for _ in thresholds] for _ in range(depth)])
    width = 1 << (shard_bits - 3)
    for got in parts.mapInArrow(merge, "shard int, planes array<binary>").toLocalIterator():
        row, s = divmod(got["shard"], shards)
        for t, plane in enumerate(got["planes"]):
            sketch.planes[row][t][s * width : (s + 1) * width] = np.frombuffer(plane, np.uint8)
    release(rows.sparkSession)
    return sketch

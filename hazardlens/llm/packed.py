"""Entries with a 64-bit hash, dealt to groups by ranges of the hash in packed columns, a few bytes an entry.

A task sorts its entries by hash in runs of ``FLUSH``; a run's part for a group is one row. Hashes are packed as gaps, all numbers
by planes of equal weight, so that what a run's numbers have in common costs nothing once Spark compresses it. The number
of groups follows the entries, so a group's size does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData

from hazardlens.llm.kernel import U

GROUP = 1 << 21  # entries of a group on average
FLUSH = 1 << 20


def parts(entries: int, low: int = 0, high: int = 1 << 64) -> list[int]:
    """Where the groups of so many evenly hashed entries begin between two hashes."""
    n = max(1, math.ceil(entries / GROUP))
    return [low + (high - low) * i // n for i in range(n)]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(packed: pa.Scalar, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed.as_buffer(), np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def squeezed(values: np.ndarray) -> bytes:
    """Planes compressed further, for numbers that are far from random."""
    return len(values).to_bytes(8, "little") + pa.compress(planes(values), codec="zstd", asbytes=True)


def unsqueezed(packed: pa.Scalar, kind: type) -> np.ndarray:
    raw, width = packed.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    whole = pa.decompress(raw[8:], decompressed_size=n * width, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def deal(rows: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Sequence[np.ndarray]]], starts: list[int], width: int) -> GroupedData:
    """Groups of packed entries; ``entries`` yields ``width`` arrays of one length each, the first of hashes."""
    edges, names = np.array(starts, np.uint64), [f"c{i}" for i in range(width)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(whole[0])
            whole = [x[order] for x in whole]
            cuts = np.append(np.searchsorted(whole[0], edges), len(order))
            some = np.flatnonzero(np.diff(cuts))
            columns = [pa.array([planes(np.diff(x[cuts[i] : cuts[i + 1]], prepend=U(0)) if x is whole[0] else x[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()) for x in whole]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *columns], ["part", *names])

        for batch in batches:
            for found in entries(batch):
                held.append(found)
                size += len(found[0])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(send, ", ".join(["part int", *(f"{n} binary" for n in names)])).groupBy("part")


def repeated(group: pa.Table, kinds: Sequence[type]) -> list[np.ndarray]:
    """The columns of a group's entries whose hash stands in it more than once, sorted by hash."""
    whole = []
    for i, kind in enumerate(kinds):
        some = [unplaned(x, kind) for x in group.column(f"c{i}")]
        whole.append(np.concatenate([np.cumsum(x) for x in some] if i == 0 else some))
    order = np.argsort(whole[0])
    h = whole[0][order]
    same = np.concatenate([[False], h[1:] == h[:-1], [False]])
    order = order[np.flatnonzero(same[1:] | same[:-1])]
    return [x[order] for x in whole]

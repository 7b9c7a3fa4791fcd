"""Vectorised text helpers for Arrow batches: bytes, words, rolling hashes, n-grams.

Everything works on a batch in blocks of a few megabytes, so memory depends on the block and on the longest single
text, never on the batch or partition. Hashes are fixed functions of the bytes, so a retried task repeats its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For comparing passages: all ASCII but letters and digits separates words, so punctuation does not count.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of a hash."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=8)
def _byte_codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix((np.arange(256, dtype=np.uint64) + U(1 + 1000 * seed)) * U(_STEP)) | U(1)
    return codes[LOWER] if lower else codes


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        inverse = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("down", inverse)):
            out = np.full(size, U(base))
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive 64-bit values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


@dataclass
class Block:
    """Some whole texts of a batch: their bytes end to end, and where each begins and ends."""

    first: int
    data: np.ndarray
    edges: np.ndarray

    def __len__(self) -> int:
        return len(self.edges) - 1


@dataclass
class Words:
    """Words of a block in order: byte bounds, and the text (its index in the block) each is from."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray  # bounds[i]:bounds[i + 1] are the words of text i


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow string column; null counts as empty. A text over ``limit`` is a block of its own."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    n = len(column)
    if n == 0:
        return
    raw = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(raw[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def words(block: Block, space: np.ndarray = SPACE) -> Words:
    """Maximal runs, inside each text, of bytes that ``space`` does not hold: by default space and \\x09-\\x0D."""
    n = len(block.data)
    solid = ~space[block.data]
    edge = np.zeros(n + 1, bool)
    edge[block.edges] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    bounds = np.searchsorted(start, block.edges)
    return Words(start, end, np.repeat(np.arange(len(block)), np.diff(bounds)), bounds)


def word_hashes(block: Block, found: Words, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower`` A-Z count as a-z."""
    n = len(block.data)
    if n == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes(seed, lower)[block.data] * up, out=sums[1:])
    return mix((sums[found.end] - sums[found.start]) * down[found.start])


def byte_hashes(block: Block, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` bytes of the block, also across texts; see ``inside``."""
    return rolling(_byte_codes(seed, False)[block.data], width)


def inside(bounds: np.ndarray, width: int) -> np.ndarray:
    """Which of the runs of ``width`` items, numbered by their start, lie inside one text."""
    total = int(bounds[-1])
    ok = np.zeros(max(0, total - width + 1), bool)
    mark = np.zeros(total + 1, np.int64)
    sizes = np.diff(bounds)
    has = sizes >= width
    np.add.at(mark, bounds[:-1][has], 1)
    np.add.at(mark, bounds[1:][has] - width + 1, -1)
    ok[:] = np.cumsum(mark)[: len(ok)] > 0
    return ok


def text_hashes(block: Block, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each whole text, its length included."""
    n = len(block.data)
    up, down = powers(max(n, 1) + 1)
    sums = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(_byte_codes(seed, False)[block.data] * up[:n], out=sums[1:])
    low, high = block.edges[:-1], block.edges[1:]
    return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64) * U(_STEP))


def shingle_sets(block: Block, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its index and the sorted distinct hashes of its ``width``-word shingles, A-Z as a-z.

    Fewer words than ``width`` count as one shingle of them all; no words give an empty set.
    """
    found = words(block)
    hashes = word_hashes(block, found)
    grams = rolling(hashes, width)
    for i in range(len(block)):
        a, b = int(found.bounds[i]), int(found.bounds[i + 1])
        if b - a >= width:
            yield i, np.unique(grams[a : b - width + 1])
        elif b > a:
            yield i, rolling(hashes[a:b], b - a) ^ U(b - a)
        else:
            yield i, np.zeros(0, np.uint64)


def pack_gaps(ordered: np.ndarray) -> bytes:
    """Ascending integers as bytes: each gap g as g // 255 bytes of 255 and one of g % 255."""
    gaps = np.diff(ordered, prepend=0).astype(np.int64)
    q = gaps // 255
    ends = np.cumsum(q + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = (gaps - 255 * q).astype(np.uint8)
    return out.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw < 255]


class Table:
    """Sorted distinct hashes, found by their leading bits and a few steps; hashes are even, so buckets are short."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, int(len(hashes)).bit_length())
        buckets = np.arange((1 << self.bits) + 1, dtype=np.uint64)
        head = (hashes >> U(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(head, buckets.astype(np.int64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, or -1."""
        head = (wanted >> U(64 - self.bits)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out = np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.hashes[at] == wanted[left]
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out

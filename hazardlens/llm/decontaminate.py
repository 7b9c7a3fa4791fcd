"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

A first scan counts, for the n-grams of the test items only, the documents that hold them. A seed is every n-gram that
occurs at all, up to ``FREQUENT`` of the documents, and of every ``STRIDE`` consecutive ones the rarest that occurs, so
each stretch of an item keeps one however common the item is. A second scan joins seeds to documents and aligns each
passage round a seed with its item, word by word, with gaps; edited, cut and reordered copies still score, if three
words in a row are intact somewhere. Passages that share too few words to reach the threshold are not aligned. What is
broadcast is one slice of the items of at most ``SLICE_BYTES``; larger benchmarks take several slices, each complete
in itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm import kernel
from hazardlens.llm.common import written

SEED_WORDS = 3
STRIDE = 3
FREQUENT, FEW_DOCS = 0.1, 1000  # of all documents; that many are never too many
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
SLICE_BYTES = 1 << 24
_FILTER_BITS = 20


def _hashed(block: kernel.Block):
    found = kernel.words(block, kernel.NOT_ALNUM)
    return found, kernel.word_hashes(block, found)


class _Finder:
    """Places of known hashes in an array: a small bitmap first, then a binary search of what is left."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[(self.keys >> kernel.U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bitmap[(hashes >> kernel.U(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def _grams(block: kernel.Block, size: int):
    found, h = _hashed(block)
    return found, h, kernel.rolling(h, size), kernel.inside(found.bounds, size)


def align(item: np.ndarray, passages: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each padded row of word hashes, and the place it ends at."""
    n, width = passages.shape
    steps = np.arange(width) * -GAP
    row = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    beyond = np.arange(width)[None, :] >= lengths[:, None]
    for word in item:
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        new = np.maximum(diagonal + np.where(passages == word, MATCH, MISMATCH), row + GAP)
        new = np.maximum.accumulate(np.maximum(new, 0) + steps, axis=1) - steps
        new[beyond] = 0
        row = new.astype(np.int32)
        high = row.argmax(1)
        top = row[np.arange(n), high]
        end = np.where(top > best, high, end)
        best = np.maximum(best, top)
    return best, end


def _item_words(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for block in kernel.blocks(texts):
        found, h = _hashed(block)
        out += [h[found.bounds[i] : found.bounds[i + 1]] for i in range(len(block))]
    return out


def _slices(benchmark: DataFrame) -> list[tuple[list, list[np.ndarray]]]:
    """The items as (ids, word hashes) in slices of at most SLICE_BYTES of text, or of one item. Blank items are left out."""
    items = written(benchmark.filter("item_id is not null").select("item_id", "text").distinct(), "items")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-held // (SLICE_BYTES // 2)))
    out = []
    for part in range(parts):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        ids, texts = got.column("item_id").to_pylist(), _item_words(got.column("text"))
        keep = [i for i, w in enumerate(texts) if len(w)]
        out.append(([ids[i] for i in keep], [texts[i] for i in keep]))
    return out


def _seeds(docs: DataFrame, items: list[np.ndarray]):
    """Finder of the seed hashes and, for each, its (item number, place in the item). An n-gram in no document is no seed."""
    size = lambda w: min(SEED_WORDS, len(w))  # noqa: E731  an item of fewer words is one seed
    grams = [kernel.rolling(w, size(w)) ^ kernel.U(size(w)) for w in items]
    every = _Finder(np.concatenate(grams) if grams else np.zeros(0, np.uint64))
    sizes = sorted({size(w) for w in items})
    shared = docs.sparkSession.sparkContext.broadcast(every)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(shared.value.keys), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in kernel.blocks(batch.column(0)):
                for n in sizes:
                    found, _, h, ok = _grams(block, n)
                    at, key = shared.value.find(h ^ kernel.U(n))
                    at, key = at[ok[at]], key[ok[at]]
                    once = np.unique(found.text[at] * len(total) + key) % max(1, len(total))
                    total += np.bincount(once, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["key", "docs"])

    frequency = np.zeros(len(every.keys) + 1, np.int64)  # the last is the number of documents
    for r in docs.select("text").mapInArrow(count, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs")).toLocalIterator():
        frequency[r["key"]] = r["docs"]
    most = max(FEW_DOCS, FREQUENT * frequency[-1])
    chosen: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(grams):
        held = frequency[np.searchsorted(every.keys, own)]
        for at in range(0, len(own), STRIDE):
            part = [p for p in range(at, min(at + STRIDE, len(own))) if held[p]]
            rarest = min(part, key=lambda p: (held[p], own[p]), default=None)
            for place in part:
                if place == rarest or held[place] <= most:
                    chosen.setdefault(int(own[place]), []).append((i, place))
    finder = _Finder(np.array(list(chosen), np.uint64))
    return finder, [chosen[int(k)] for k in finder.keys], sizes


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, item_words, coverage, start_word, end_word): each document with each item it leaks.

    Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. ``coverage`` is the best local alignment's
    score as a share of the item's own, over all passages round a seed; rows below ``threshold`` are left out. Equal
    rows of (doc_id, item_id) come once, with the best. Null, empty and blank texts and items leak nothing; a null
    doc_id is reported as null. Only doc_id, item_id and text are read. ``start_word``:``end_word`` is the passage.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score int, item_words int, coverage double, start_word long, end_word long"
    for ids, items in _slices(benchmark):
        finder, places, sizes = _seeds(docs, items)
        shared = spark.sparkContext.broadcast((ids, items, finder, places, sizes))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, items, finder, places, sizes = shared.value
            for batch in batches:
                doc_ids = batch.column(0)
                for block in kernel.blocks(batch.column(1)):
                    found, h = _hashed(block)
                    regions: dict[int, list[tuple[int, int, int]]] = {}
                    for n in sizes:
                        grams, ok = kernel.rolling(h, n), kernel.inside(found.bounds, n)
                        at, key = finder.find(grams ^ kernel.U(n))
                        for a, k in zip(at[ok[at]].tolist(), key[ok[at]].tolist()):
                            text = int(found.text[a])
                            low, high = int(found.bounds[text]), int(found.bounds[text + 1])
                            for i, place in places[k]:
                                length = len(items[i])
                                slack = 2 + length // 2
                                first = max(low, a - place - slack)
                                regions.setdefault(i, []).append((text, first, min(high, a - place + length + slack)))
                    rows = []
                    for i, some in regions.items():
                        rows += _scored(h, items[i], i, some, threshold)
                    rows = [(doc_ids[block.first + t].as_py(), ids[i], s, len(items[i]), s / (MATCH * len(items[i])), a - int(found.bounds[t]), b - int(found.bounds[t])) for i, t, s, a, b in rows if s >= threshold * MATCH * len(items[i])]
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)

        names = ["doc_id", "item_id", "score", "item_words", "coverage", "start_word", "end_word"]
        arrow = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()])))
        hits = docs.select("doc_id", "text").mapInArrow(scan, schema)
        out = hits if out is None else out.union(hits)
    best = F.max_by(F.struct("score", "item_words", "coverage", "start_word", "end_word"), F.struct("coverage", -F.col("start_word"), -F.col("end_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _shared(own: np.ndarray, words: np.ndarray) -> int:
    """How many of ``words`` are among the sorted ``own``."""
    return int((own[np.minimum(np.searchsorted(own, words), len(own) - 1)] == words).sum())


def _scored(h: np.ndarray, item: np.ndarray, number: int, some: list[tuple[int, int, int]], threshold: float) -> list[tuple]:
    """(item, text, score, start, end) of each merged region; regions of one text that overlap are one."""
    merged: list[list[int]] = []
    for text, a, b in sorted(set(some)):
        if merged and merged[-1][0] == text and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([text, a, b])
    # a long merged region is cut into overlapping pieces that hold any single alignment, so memory stays bounded
    piece, pieces = 8 * len(item) + 64, []
    for text, a, b in merged:
        while True:
            pieces.append((text, a, min(b, a + piece)))
            if a + piece >= b:
                break
            a += piece - 4 * len(item) - 8
    # no alignment scores more than a match for each word of a piece that is also in the item
    own = np.unique(item)
    pieces = [(text, a, b) for text, a, b in pieces if MATCH * min(len(item), _shared(own, h[a:b])) >= threshold * MATCH * len(item)]
    out = []
    for at in range(0, len(pieces), 256):
        part = pieces[at : at + 256]
        lengths = np.array([b - a for _, a, b in part])
        passages = np.zeros((len(part), int(lengths.max())), np.uint64)
        for r, (_, a, b) in enumerate(part):
            passages[r, : b - a] = h[a:b]
        score, end = align(item, passages, lengths)
        for (text, a, b), s, e in zip(part, score.tolist(), end.tolist()):
            back = h[a : a + e + 1][::-1]
            _, start = align(item[::-1], back[None, :], np.array([len(back)])) if s >= threshold * MATCH * len(item) else (0, [e])
            out.append((number, text, s, a + e - int(start[0]), a + e + 1))
    return out

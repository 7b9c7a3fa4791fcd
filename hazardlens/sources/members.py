"""Feed documents that are larger than a task: the members of one array, read by byte ranges.

A feed document is one JSON object whose rows are the objects of one of its arrays, so a reader that parses documents gives
one task the whole file. Here Spark's text source cuts files into its usual splits, behind a closing brace. What a split
cannot know by itself is whether it begins inside a string, how deep, and in which array. Two steps settle that:

1. every split reports how it changes both possible beginnings, outside and inside a string: the depth it adds and, for
   each depth relative to its beginning, what it opened there last. These summaries, one small row for each split, are
   chained in file order on the driver, which holds Spark's list of the splits anyway: each split's true beginning;
2. with it every split lists the members that lie within it. A member that a split only begins, continues or ends leaves a
   piece; pieces, at most two for each split, are listed by a scan of their own, shuffled and joined.

Quotes behind a backslash and braces in strings are told apart from others; a split never begins behind a backslash, as
none stands before a closing brace. Works on every store that Spark reads; compressed files are one split.

Defined cases: members that are no objects, objects elsewhere and members that never end give no row; a file may hold several
documents one after another; a document that is an array itself has no members. Of a file that ends early, a member that lacks
nothing but its last brace is given.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens.functions.rows import evaluate_once

_QUOTE, _ESCAPE, _BRACE, _BRACKET = (ord(c) for c in '"\\{[')
_STEP = np.zeros(256, np.int8)
_STEP[[_BRACE, _BRACKET]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[_QUOTE] = True
#: Depth of a document's arrays and of what lies in them.
_ARRAY, _MEMBER = 2, 3
_OBJECT = "{"


def _pieces(spark: SparkSession, path) -> DataFrame:
    """The text of the files in order, cut behind closing braces, with the split that it is from."""
    lines = spark.read.text(path, lineSep="}")
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.concat("value", F.lit("}")).alias("value")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(file, start, bytes): what follows one another in a split."""
    for batch in batches:
        if not len(batch):
            continue
        file, start, value = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        wide = np.int64 if pa.types.is_large_string(value.type) else np.int32
        offsets = np.frombuffer(value.buffers()[1], wide)[value.offset : value.offset + len(value) + 1].astype(np.int64)
        data = np.frombuffer(value.buffers()[2], np.uint8)
        new = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for lo, hi in zip(np.append(0, new), np.append(new, len(batch))):
            yield int(file[lo]), int(start[lo]), data[offsets[lo] : offsets[hi]]


class _Text:
    """Some text of a split: its braces and brackets, and how many quotes that begin or end a string stand before each."""

    def __init__(self, data: np.ndarray):
        self.data, self.raw = data, data.tobytes()
        at = np.flatnonzero(_MARK[data])
        quote = data[at] == _QUOTE
        behind_slash = np.flatnonzero(quote & (at > 0) & (data[at - 1] == _ESCAPE))
        run, open_ = np.ones(len(behind_slash), np.int64), np.arange(len(behind_slash))
        while len(open_):  # backslashes before a quote; an odd number escapes it
            before = at[behind_slash[open_]] - 1 - run[open_]
            open_ = open_[(before >= 0) & (data[before] == _ESCAPE)]
            run[open_] += 1
        counted = quote.copy()
        counted[behind_slash[run % 2 == 1]] = False
        odd = np.cumsum(counted, dtype=np.int32) % 2 == 1
        self.at, self.step, self.odd = at[~quote], _STEP[data[at[~quote]]], odd[~quote]
        self.is_odd = bool(len(odd) and odd[-1])

    def walked(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What each brace or bracket adds to the depth, and the depth behind it, for text that begins like this."""
        step = np.where(self.odd ^ inside, 0, self.step)
        return step, depth + np.cumsum(step, dtype=np.int64)


def _key_before(raw: bytes, at: int) -> str:
    """The key of what opens at ``at``; "" where it has none, or where a cut lies in the key, which then holds a brace."""
    end = raw.rfind(b'"', 0, at)
    begin = raw.rfind(b'"', 0, max(end, 0))
    return raw[begin + 1 : end].decode("utf-8", "replace") if begin >= 0 and raw[end + 1 : at].strip() == b":" else ""


def _opened(raw: bytes, at: int) -> str:
    """What opens at ``at``: an object, or an array with its key."""
    return _OBJECT if raw[at] == _BRACE else "[" + _key_before(raw, at)


@dataclass(frozen=True)
class _Place:
    """A place in a document: in a string or not, how deep, and what was opened last at each depth."""

    inside: bool = False
    depth: int = 0
    opened: dict[int, str] = field(default_factory=dict)

    def behind(self, text: _Text) -> _Place:
        """The place behind some text."""
        step, depth = text.walked(self.inside, self.depth)
        opens = np.flatnonzero(step == 1)
        levels, last = np.unique(depth[opens][::-1], return_index=True)
        new = {int(d): _opened(text.raw, int(text.at[opens[len(opens) - 1 - i]])) for d, i in zip(levels, last)}
        return _Place(text.is_odd ^ self.inside, int(depth[-1]) if len(depth) else self.depth, self.opened | new)

    def then(self, change: _Place) -> _Place:
        """The place behind a split that changes a beginning at depth 0 to ``change``."""
        return _Place(change.inside, self.depth + change.depth, self.opened | {self.depth + d: o for d, o in change.opened.items()})


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, outside, inside): for each split, where text leads that begins outside or inside a string, as JSON."""
    at, places, out = None, [], []

    def told() -> tuple:
        return *at, *(json.dumps([p.inside, p.depth, sorted(p.opened.items())]) for p in places)

    for file, start, data in _runs(batches):
        if (file, start) != at:
            out += [told()] if at else []
            at, places = (file, start), [_Place(False), _Place(True)]
        text = _Text(data)
        places = [p.behind(text) for p in places]
    out += [told()] if at else []
    if out:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "start", "outside", "inside"])


def _beginnings(summaries: Iterable[tuple]) -> dict[tuple[int, int], _Place]:
    """How each split begins, from the summaries in the order of file and start."""
    out, file_at, place = {}, None, _Place()
    for file, start, *changes in summaries:
        if file != file_at:
            file_at, place = file, _Place()
        out[file, start] = replace(place, opened={d: o for d, o in place.opened.items() if d in (_ARRAY, _MEMBER)})
        inside, depth, opened = json.loads(changes[place.inside])
        place = place.then(_Place(inside, depth, {int(d): o for d, o in opened}))
    return out


class _Split:
    """One split while its text comes in, from its true beginning."""

    def __init__(self, file: int, start: int, place: _Place, member: str):
        self.file, self.start, self.place, self.array = file, start, place, "[" + member
        self.held: list[bytes] = []  # of a member that has not ended
        self.begun = False  # whether it began in this split

    def _wanted(self) -> bool:
        return self.place.depth >= _MEMBER and self.place.opened.get(_ARRAY) == self.array and self.place.opened.get(_MEMBER) == _OBJECT

    def members(self, data: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """(kind, text) of the wanted members that end in ``data``."""
        text = _Text(data)
        raw, (step, depth) = text.raw, text.walked(self.place.inside, self.place.depth)
        arrays = text.at[(step == 1) & (depth == _ARRAY)]
        begins = text.at[(step == 1) & (depth == _MEMBER)]
        ends = text.at[(step == -1) & (depth == _MEMBER - 1)]
        if self._wanted():
            to = int(ends[0]) + 1 if len(ends) else len(raw)
            self.held.append(raw[:to])
            if len(ends):
                yield "whole" if self.begun else "end", b"".join(self.held)
                self.held, self.begun = [], False
        # Ends that belong to begins in this text follow one another; an array holds from its opening to the next.
        ends = ends[len(ends) - len(begins) + (int(depth[-1]) >= _MEMBER if len(depth) else 0) :]
        keys = [self.place.opened.get(_ARRAY, ""), *(_opened(raw, int(a)) for a in arrays)]
        own = np.array([k == self.array for k in keys])[np.searchsorted(arrays, begins)]
        own &= data[begins] == _BRACE
        for lo, hi in zip(begins[: len(ends)][own[: len(ends)]], ends[own[: len(ends)]]):
            yield "whole", raw[lo : hi + 1]
        if len(begins) > len(ends) and own[-1]:
            self.held, self.begun = [raw[begins[-1] :]], True
        self.place = self.place.behind(text)

    def rest(self) -> Iterator[tuple[str, bytes]]:
        """The piece of a member that goes on in the next split."""
        if self.held:
            yield "begin" if self.begun else "middle", b"".join(self.held)


_LISTED = "file long, start long, seq long, kind string, value string"


def _found(batches: Iterable[pa.RecordBatch], beginnings: dict, member: str) -> Iterator[tuple[_Split, str, bytes]]:
    """(split, kind, text) of the wanted members and pieces in order."""
    split = None
    for file, start, data in _runs(batches):
        if split is None or (file, start) != (split.file, split.start):
            if split:
                yield from ((split, *r) for r in split.rest())
            split = _Split(file, start, beginnings[file, start], member)
        yield from ((split, *r) for r in split.members(data))
    if split:
        yield from ((split, *r) for r in split.rest())


def _listed(pieces: DataFrame, beginnings: dict, member: str, whole: bool) -> DataFrame:
    """Members that lie within a split, or the pieces of the others."""
    sent = pieces.sparkSession.sparkContext.broadcast(beginnings)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def packed() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "start", "seq", "kind", "value"])

        for seq, (split, kind, text) in enumerate(_found(batches, sent.value, member)):
            if (kind == "whole") == whole:
                out.append((split.file, split.start, seq, kind, text.decode("utf-8", "replace")))
                size += len(text)
                if size > 1 << 22:
                    yield packed()
                    out, size = [], 0
        if out:
            yield packed()

    return pieces.mapInArrow(work, _LISTED)


def read_members(spark: SparkSession, path, member: str) -> DataFrame:
    """(value): each object of the array ``member`` of the documents under ``path``, as JSON text."""
    pieces = _pieces(spark, path)
    summaries = pieces.mapInArrow(_summaries, "file long, start long, outside string, inside string")
    beginnings = _beginnings(sorted(summaries.collect()))  # one small row for each split
    parts = _listed(pieces, beginnings, member, whole=False)
    chain = Window.partitionBy("file").orderBy("start", "seq")
    numbered = parts.withColumn("n", F.count_if(F.col("kind") == "begin").over(chain))
    in_order = F.array_sort(F.collect_list(F.struct("start", "seq", "value")))
    joined = numbered.groupBy("file", "n").agg(F.array_join(F.transform(in_order, lambda p: p["value"]), "").alias("value"), F.max(F.col("kind") == "end").alias("ended"))
    return _listed(pieces, beginnings, member, whole=True).select("value").union(joined.filter("ended").select("value"))


def as_documents(members: DataFrame, schema: StructType, member: str) -> DataFrame:
    """Each member as a document of its own, in the shape that the row functions of the feeds take."""
    element = F.from_json("value", schema[member].dataType.elementType)
    return evaluate_once(members, F.array(element).alias(member)).filter(F.get(member, F.lit(0)).isNotNull())

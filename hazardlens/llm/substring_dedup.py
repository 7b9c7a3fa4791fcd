"""Substring dedup: windows of words that also start in an earlier document are cut out.

A merged count-min sketch first says which windows may occur more than once. It never says less than the true count,
so the second pass, which groups only those windows exactly, loses none. Grouping is a running minimum per window
key, sorted by document, so the documents that share a hot window stream past and are never held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm import kernel, sketch
from hazardlens.llm.common import Members, has_bit, written

WINDOW_WORDS = 13


def _window_hashes(block: kernel.Block, width: int, seed: int = 0):
    found = kernel.words(block)
    h = kernel.rolling(kernel.word_hashes(block, found, lower=False, seed=seed), width)
    at = np.flatnonzero(kernel.inside(found.bounds, width))
    return found, h, at


def ids_repeat(docs: DataFrame) -> bool:
    """Whether some doc_id stands in more than one row; rows then need their text's hash as well to be told apart."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())


def covered(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, mark, starts): the windows of each row that start in a document with a smaller doc_id as well.

    A written table. A window that a row repeats is listed with its first start only, so a line that fills a text is one
    row to group. Rows without such windows are not listed. ``mark`` is 0, or the text's hash where doc_ids repeat.
    """
    marked = ids_repeat(docs)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in kernel.blocks(batch.column(0)):
            _, h, at = _window_hashes(block, width)
            yield h[at]

    text = docs.select("text")
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # about six bytes a word, one window a word
    repeated = sketch.build(text, hashes, sketch.bits_for(total // 6))
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column(0)
            for block in kernel.blocks(batch.column(1)):
                found, h, at = _window_hashes(block, width)
                at = at[known.level(h[at]) > 0]
                if not len(at):
                    continue
                order = np.lexsort((at, h[at], found.text[at]))
                again = (np.diff(h[at[order]], prepend=0) == 0) & (np.diff(found.text[at[order]], prepend=-1) == 0)
                at = at[order][~again]
                text_of = found.text[at]
                check = kernel.rolling(kernel.word_hashes(block, found, lower=False, seed=1), width)[at] >> kernel.U(32)
                place = (at - found.bounds[text_of]).astype(np.uint64)
                mark = kernel.text_hashes(block)[text_of].view(np.int64) if marked else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(((check << kernel.U(32)) | place).view(np.int64)), ids.take(pa.array(text_of + block.first)), pa.array(mark)],
                    ["h", "x", "doc_id", "mark"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(candidates, "h long, x long, doc_id long, mark long")
    order = Window.partitionBy("h", F.shiftrightunsigned("x", 32)).orderBy(F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("doc_id").over(order)
    later = rows.withColumn("first", first).filter("first < doc_id or (doc_id is null and first is not null)")
    starts = F.sort_array(F.collect_set(F.col("x").bitwiseAND((1 << 32) - 1).cast("int")))
    out = written(later.groupBy("doc_id", "mark").agg(starts.alias("starts")), "covered")
    shared.destroy()
    return out


def dedup(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the text without the covered words, kept words joined by one space.

    Needs doc_id and text, other columns are ignored. A null text has no words. Rows of one doc_id are judged each on
    its own and never remove from each other; a null doc_id comes after all others. No rows give no rows.
    """
    marked = ids_repeat(docs)
    flags = covered(docs, width)
    members = Members(flags, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(members.map)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely lose nothing are done here; only the others travel."""
        for batch in batches:
            maybe = has_bit(shared.value, batch.column(2).to_numpy(zero_copy_only=False))
            marks = np.concatenate([kernel.text_hashes(b) for b in kernel.blocks(batch.column(1))]).view(np.int64) if marked and len(maybe) else np.zeros(len(maybe), np.int64)
            n, kept, text = [], [], []
            for value, open_ in zip(batch.column(1), maybe):
                own = (value.as_py() or "").encode().split()
                n.append(len(own))
                kept.append(None if open_ else b" ".join(own).decode())
                text.append(b" ".join(own).decode() if open_ else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "mark", "n_words", "kept", "rest"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for block in kernel.blocks(batch.column(3)):
                found, h, _ = _window_hashes(block, width)
                for i in range(len(block)):
                    row = block.first + i
                    if batch.column(2)[row].is_valid:
                        removed.append(0)
                        kept.append(batch.column(2)[row].as_py())
                        continue
                    low, n = int(found.bounds[i]), int(found.bounds[i + 1] - found.bounds[i])
                    keep, starts = np.ones(n, bool), batch.column(4)[row]
                    if starts.is_valid:
                        own = h[low : low + n - width + 1]
                        at = np.flatnonzero(np.isin(own, own[starts.values.to_numpy()]))
                        step = np.zeros(n + 1, np.int64)
                        step[at] += 1
                        np.add.at(step, at + width, -1)
                        keep = np.cumsum(step)[:n] == 0
                    own = block.data[block.edges[i] : block.edges[i + 1]].tobytes().split()
                    kept.append(b" ".join([w for w, k in zip(own, keep.tolist()) if k]).decode())
                    removed.append(int(n - keep.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    rows = docs.select("doc_id", "text", members.cell().alias("cell")).mapInArrow(
        plain, "doc_id long, mark long, n_words long, kept string, rest string"
    )
    f = flags.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "starts")
    joined = rows.join(f, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    return joined.select("doc_id", "n_words", "kept", "rest", "starts").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")

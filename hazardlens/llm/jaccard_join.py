"""N-gram Jaccard join: documents link when their sets of word shingles overlap enough; exact, without all pairs.

Documents with equal sets are one row from the start. Of each set only a size-derived prefix, its first shingles by
one global order, can be the first thing that two linked sets share; prefixes that share a shingle and whose sizes
allow a link join a cluster. In that order the shingles with the smallest hashes, twice as many as a prefix needs on average,
come first, and among them those that the fewest sets have. Only these are counted: each set sends them, and the others too if
they are fewer than its prefix, packed to groups by hash, and a group answers for those that it has from two sets or more. So what is
dealt out grows with the documents and nothing is broadcast. Inside a cluster the document by n-gram incidence is multiplied with its transpose block
by block: blocks hold a bounded number of shingles, in order of set size, and block pairs or rows outside the size
bounds are passed over. A block pair returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm import kernel, packed
from hazardlens.llm.common import Members, components, has_bit, written

BLOCK_SHINGLES = 1 << 20
ROW_WEIGHT = 1 << 10  # so a block has at most 1,024 sets as well
U = kernel.U


def _sets(block: kernel.Block, width: int):
    """Shingle sets of a block end to end: hashes, the bounds of each text's, and a hash of each set."""
    own = [s for _, s in kernel.shingle_sets(block, width)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)
    every = np.concatenate(own) if own else np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(every ^ kernel.U(0x5DEECE66D)))])
    sizes = np.diff(bounds)
    return every, bounds, kernel.mix((sums[bounds[1:]] - sums[bounds[:-1]]) + sizes.astype(np.uint64))


def _least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """A set of n shingles shares at least this many with any set that it links with."""
    return -((-num * n) // den)


def _early(num: int, den: int) -> int:
    """Shingles with smaller hashes come first in the order: twice as many as a prefix needs on average."""
    return min((1 << 64) - 1, 2 * (den - num) * (1 << 64) // den)


def _shared(texts: DataFrame, asked, starts: list[int], low: int) -> DataFrame:
    """(s, h, late, c) for each hash h that ``asked`` gives for two sets s or more; c is their number."""
    def answer(group: pa.Table) -> pa.Table:
        h, s = packed.repeated(group, (np.uint64, np.int64))
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[once], s[once]
        _, of, times = np.unique(h, return_inverse=True, return_counts=True)
        c = times[of]
        more = c > 1
        return pa.table({"s": s[more], "h": h[more].view(np.int64), "late": h[more] >= U(low), "c": c[more]})

    return packed.deal(texts, asked, starts, 2).applyInArrow(answer, "s long, h long, late boolean, c long")


def link(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, mark, class): one row for each row of ``docs``.

    Two rows link when den * intersection >= num * union of their distinct ``width``-word shingles (A-Z as a-z; fewer
    words are one shingle of them all). component_id is the smallest doc_id reachable by links; n_links counts linked
    rows. Null, empty and blank texts have no shingles, link with nothing and are their own component. A null doc_id
    takes part and never becomes a component_id unless the component has no other. ``mark`` is xxhash64 of the text,
    ``class`` a number of the component that does not depend on ids (null without shingles). Only doc_id and text are read.
    """
    low = _early(num, den)

    def early(every: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(every < U(low))])
        return before[bounds[1:]] - before[bounds[:-1]]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                every, bounds, own = _sets(block, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(np.diff(bounds)), pa.array(own.view(np.int64)), batch.column(2).slice(block.first, len(block)), pa.array(early(every, bounds))],
                    ["doc_id", "n", "s", "mark", "early"],
                )

    rows = written(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(describe, "doc_id long, n long, s long, mark long, early long"), "sets")
    classes = rows.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("early").alias("early"))

    prefix = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
    short = F.col("early") < prefix
    total = rows.agg(F.sum("early").alias("early"), F.sum(F.when(short, F.col("n") - F.col("early"))).alias("late")).first()

    def asked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in kernel.blocks(batch.column(0)):
            every, bounds, own = _sets(block, width)
            n = np.diff(bounds)
            all_of = early(every, bounds) < n - _least_overlap(n, num, den) + 1
            text = np.repeat(np.arange(len(n)), n)
            some = np.flatnonzero((every < U(low)) | all_of[text])
            yield every[some], own.view(np.int64)[text[some]]

    shared = _shared(docs.select("text"), asked, packed.parts(total["early"] or 0, 0, low) + packed.parts(total["late"] or 0, low), low)
    # a set's shingles that no other has come first, so of the shared ones only so many more are in its prefix; ties all are
    own = Window.partitionBy("s")
    place = F.rank().over(own.orderBy("late", "c", "h")) - 1
    known = F.count("*").over(own)
    within = shared.join(classes.select("s", "n", "early"), "s").withColumns({"p": prefix, "place": place, "k": known, "k0": F.count_if(~F.col("late")).over(own)})
    within = within.filter(F.when(F.col("late"), F.expr("place < p - n + k")).otherwise(F.expr("place < p - early + k0")))

    order = Window.partitionBy("h").orderBy("n", "s")
    apart = F.coalesce(F.lag("n").over(order) * den < F.col("n") * num, F.lit(True))
    hub = F.last(F.when(F.col("apart"), F.col("s")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    meet = within.select("h", "s", "n").withColumn("apart", apart)
    edges = meet.withColumn("hub", hub).filter("hub != s").select(F.col("s").alias("a"), F.col("hub").alias("b"))
    clusters = components(edges)

    order = Window.partitionBy("root").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, 0)
    placed = (F.sum(F.col("n") + ROW_WEIGHT).over(order) - 1) / F.lit(BLOCK_SHINGLES)
    inside = written(
        clusters.join(classes.withColumnRenamed("s", "node"), "node").withColumn("block", F.floor(placed)), "clusters"
    )
    spans = inside.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    pairs = spans.alias("p").join(spans.alias("q"), "root").filter("p.block <= q.block").filter(F.col("q.low") * num <= F.col("p.high") * den)
    pairs = pairs.select("root", F.col("p.block").alias("i"), F.col("q.block").alias("j"))
    sides = pairs.withColumn("block", F.col("i")).union(pairs.filter("i < j").withColumn("block", F.col("j")))
    members = Members(inside, "node", hashed=True)
    kept = docs.sparkSession.sparkContext.broadcast((members.map, members.bits))

    def member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = kept.value
        for batch in batches:
            for block in kernel.blocks(batch.column(0)):
                every, bounds, own = _sets(block, width)
                own = own.view(np.int64)
                at = np.flatnonzero(has_bit(bitmap, own & ((1 << bits) - 1)) & (np.diff(bounds) > 0))
                _, once = np.unique(own[at], return_index=True)
                at = at[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array([every[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())], ["node", "own"]
                )

    texts = docs.select("text").mapInArrow(member_sets, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))
    work = inside.join(sides, ["root", "block"]).join(texts, "node").select("root", "i", "j", "block", "node", "n", "copies", "own")

    def product(group: pa.Table) -> pa.Table:
        node, n, copies = (group.column(c).to_numpy() for c in ("node", "n", "copies"))
        left = group.column("block").to_numpy() == group.column("i")[0].as_py()
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        every = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("own")])
        row = np.repeat(np.arange(len(n)), n)
        _, column, times = np.unique(every, return_inverse=True, return_counts=True)
        more = times[column] > 1
        row, column = row[more], column[more]
        bounds = np.searchsorted(row, np.arange(len(n) + 1))
        links, label, forest = np.zeros(len(n), np.int64), np.arange(len(n)), []
        mark = np.zeros(len(times), bool)
        for a in np.flatnonzero(left):
            fits = (n * num <= n[a] * den) & (n[a] * num <= n * den)
            fits &= (np.arange(len(n)) > a) if same else ~left
            if not fits.any():
                continue
            mark[column[bounds[a] : bounds[a + 1]]] = True
            both = np.bincount(row[mark[column]], minlength=len(n))
            mark[column[bounds[a] : bounds[a + 1]]] = False
            hit = np.flatnonzero(fits & (both * den >= num * (n + n[a] - both)))
            links[a] += copies[hit].sum()
            links[hit] += copies[a]
            for b in hit:
                if label[b] != label[a]:
                    label[label == label[b]] = label[a]
                    forest.append((node[a], node[b]))
        some = np.flatnonzero(links)
        a = np.concatenate([node[some], np.array([x for x, _ in forest], np.int64)])
        b = np.concatenate([node[some], np.array([x for _, x in forest], np.int64)])
        return pa.table({"a": a, "b": b, "links": np.concatenate([links[some], np.zeros(len(forest), np.int64)])})

    found = written(work.groupBy("root", "i", "j").applyInArrow(product, "a long, b long, links long"), "links")
    roots = components(found.select("a", "b"))
    named = roots.join(classes.withColumnRenamed("s", "node"), "node").select("node", "root", "rep")
    least = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root")
    linked = found.groupBy(F.col("a").alias("s")).agg(F.sum("links").alias("links"))
    table = classes.join(least.select(F.col("node").alias("s"), "root", "least"), "s", "left").join(linked, "s", "left").select(
        "s", F.coalesce("root", "s").alias("root"), F.coalesce("least", "rep").alias("least"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    # as a written table it is a plain side of the join, so Spark can split the rows of a set that very many share
    table = written(table, "set_classes")
    return rows.join(table, "s", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).alias("n_links"), "mark", F.when(F.col("n") > 0, F.col("root")).alias("class"),
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when of each component of ``link`` one does.

    The row with the smallest doc_id stays, of equal ids the one with the smallest text hash; null ids come last. Rows
    equal in doc_id and text become one. Rows without shingles are no copies of anything and all stay.
    """
    linked = link(docs, width, num, den)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best")
    keep = linked.filter("class is not null").groupBy("class").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.mark").alias("_mark"))
    keep = written(keep.union(linked.filter("class is null").select("doc_id", "mark").distinct()), "kept")
    own = docs.withColumn("_own", F.xxhash64("text"))
    stay = own.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_semi").drop("_own")
    ids = docs.select("doc_id", F.xxhash64("text").alias("m"))
    repeats = ids.groupBy("doc_id", "m").count().filter("count > 1").limit(1).count()
    return stay.dropDuplicates(["doc_id", "text"]) if repeats else stay

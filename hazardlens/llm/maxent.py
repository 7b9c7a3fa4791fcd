"""Language-model scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

The vocabulary is every training token. A token belongs to one of 256 leaves, 16 classes of 16 members: the most
frequent tokens have one each, the others share one by their last bytes, and one leaf stands for every unseen token.

    P(token | context) = P(class | context) * P(member | class, context) * a(token) / A(leaf)

Both softmaxes are linear in hashed features of the context: the token before, the two before, the one skipped to, and
the leaves of the last three. a is the token's training count, with half of each count of one given to the unseen leaf,
so all outcomes sum to one. In training, too, half of the tokens that occur once stand for the unseen leaf: ``Rates``
tells from counts alone how likely a token does, so it is the same wherever the token's count is stored.

Training goes in rounds, each over its own share of the training documents: every task descends the gradient on its
rows from the shared weights, and the changes are averaged, row by row, over the tasks that made them. Counts, rounds
and scores cover all documents. The rows of the weights grow with the root of the training tokens (``class_bits``), as
distinct contexts grow slower than text and what the tasks send grows with tasks times rows.

Broadcast are the weights (6 MB at 2**16 class rows, 96 MB at the most, 2**20), the rates (a byte for each of at least
four cells a distinct token, 64 MB at the most) and the counts of the ``TOP`` most frequent tokens (about 16 MB); the
counts of all others are joined to the documents that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm import kernel
from hazardlens.llm.common import release, written

WIDTH = 16
SINGLE = 128
UNSEEN = 255
TOP = 1 << 20
ROUNDS = 3
BATCH = 8192
RATE = 0.3
LEAST_BITS, MOST_BITS = 16, 20
RATE_BITS, RATE_SHARD = 26, 15
CLASS_FEATURES, MEMBER_FEATURES = (0, 1, 2, 3), (0, 3)
SHARD_ROWS = 1 << 12
_END = 0x1F83D9ABFB41BD6B
U = kernel.U


@dataclass
class Tokens:
    """Tokens of a block: hash, shared leaf by the last bytes, and the bounds of each text's tokens."""

    hashes: np.ndarray
    tail: np.ndarray
    bounds: np.ndarray


def tokens(block: kernel.Block) -> Tokens:
    """The words of each text, A-Z as a-z, then one end."""
    found = kernel.words(block)
    h = kernel.word_hashes(block, found)
    low = kernel.LOWER[block.data]
    code = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3):
        has = found.end - back >= found.start
        code |= np.where(has, low[np.maximum(found.end - back, 0)], 0).astype(np.uint64) << U(8 * (back - 1))
    bounds = found.bounds + np.arange(len(block) + 1)
    at = np.arange(len(h)) + found.text
    hashes, tail = np.full(int(bounds[-1]), _END, np.uint64), np.full(int(bounds[-1]), SINGLE, np.int64)
    hashes[at] = h
    tail[at] = SINGLE + (kernel.mix(code + U(1)) % U(UNSEEN - SINGLE)).astype(np.int64)
    return Tokens(hashes, tail, bounds)


@dataclass
class Rates:
    """For each cell of hashed tokens, how likely one of its occurrences stands for the unseen leaf, in 255ths.

    That is half of the tokens of count one over all occurrences; tokens that share a cell share its rate, so the sum
    over all occurrences is right for any number of distinct tokens.
    """

    bits: int
    values: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.values[(hashes & U((1 << self.bits) - 1)).astype(np.int64)] / 255


def unseen_rates(counted: DataFrame, distinct: int, most: int = RATE_BITS) -> Rates:
    """The rates of all counted tokens, put together by shards of cells."""
    bits = min(most, max(RATE_SHARD, math.ceil(math.log2(max(1, 4 * distinct)))))
    cell = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    cells = counted.groupBy(cell.alias("cell")).agg((0.5 * F.count_if(F.col("c") == 1) / F.sum("c")).alias("rate")).filter("rate > 0")

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(1 << RATE_SHARD, np.uint8)
        out[table.column("at").to_numpy()] = np.rint(255 * table.column("rate").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "rates": pa.array([out.tobytes()], pa.binary())})

    placed = cells.select(F.shiftright("cell", RATE_SHARD).alias("shard"), F.col("cell").bitwiseAND((1 << RATE_SHARD) - 1).alias("at"), "rate")
    values = np.zeros(1 << bits, np.uint8)
    for r in placed.groupBy("shard").applyInArrow(fill, "shard long, rates binary").toLocalIterator():
        values[r["shard"] << RATE_SHARD : (r["shard"] + 1) << RATE_SHARD] = np.frombuffer(r["rates"], np.uint8)
    return Rates(bits, values)


@dataclass
class Lexicon:
    """Counts and leaves of the most frequent tokens; masses and sums over all."""

    table: kernel.Table
    counts: np.ndarray
    leaves: np.ndarray
    mass: np.ndarray  # A of each leaf
    train_tokens: int
    distinct: int
    rates: Rates

    @property
    def base_zero(self) -> float:
        return float(np.log10(self.train_tokens + self.distinct + 1))


def kept_mass(count: Column) -> Column:
    """a(token): its count; a count of one keeps a half."""
    return F.when(count == 1, F.lit(0.5)).otherwise(count.cast("double"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, tail, c): every distinct training token with its count, as a written table."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [tokens(block) for block in kernel.blocks(batch.column(0))]
            if held:
                h, first, n = np.unique(np.concatenate([t.hashes for t in held]), return_index=True, return_counts=True)
                tail = np.concatenate([t.tail for t in held])[first]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int16)), pa.array(n)], ["h", "tail", "c"])

    rows = docs.select("text").mapInArrow(tally, "h long, tail short, c long")
    return written(rows.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")), "tokens")


def lexicon(counted: DataFrame, top: int = TOP) -> Lexicon:
    total = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("ones")).first()
    # the table holds the tokens above the smallest count that leaves at most ``top`` of them
    counts = counted.groupBy("c").agg(F.count("*").alias("v")).orderBy(F.col("c").desc()).limit(top).toArrow()
    c, v = counts.column("c").to_numpy(), counts.column("v").to_numpy()
    order = np.argsort(-c)
    fits = np.cumsum(v[order]) <= top
    least = int(c[order][fits].min()) if fits.any() else 1 << 62
    own_leaf = [r["h"] for r in counted.orderBy(F.col("c").desc(), "h").limit(SINGLE).select("h").collect()]
    got = counted.filter((F.col("c") >= least) | F.col("h").isin(own_leaf)).toArrow()
    h, n, tail = (got.column(x).to_numpy() for x in ("h", "c", "tail"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, n, tail = h[order], n[order], tail[order].astype(np.int64)
    mass = np.zeros(256)
    for r in counted.groupBy("tail").agg(F.sum(kept_mass(F.col("c"))).alias("a")).collect():
        mass[r["tail"]] += r["a"]
    single = np.searchsorted(h, np.array(own_leaf, np.int64).view(np.uint64))
    own = np.where(n[single] == 1, 0.5, n[single].astype(float))
    np.subtract.at(mass, tail[single], own)
    tail[single] = np.arange(len(single))
    mass[: len(single)] += own
    mass = np.maximum(mass, 0)
    mass[UNSEEN] = max(0.5, 0.5 * (total["ones"] or 0))
    train_tokens = total["n"] or 0
    return Lexicon(kernel.Table(h), n, tail, mass, train_tokens, total["v"], unseen_rates(counted, total["v"]))


def _features(t: Tokens, leaf: np.ndarray) -> np.ndarray:
    """For each token the hashes of its context's features, before they are cut to a table's rows."""
    n = len(t.hashes)
    start = np.zeros(n, np.int64)
    start[t.bounds[:-1]] = 1
    place = np.arange(n) - t.bounds[:-1][np.cumsum(start) - 1]

    def before(values: np.ndarray, back: int, none: int) -> np.ndarray:
        out = np.full(n, U(none), np.uint64)
        if n > back:
            out[back:] = values[:-back]
        out[place < back] = U(none)
        return out

    p1, p2 = before(t.hashes, 1, 1), before(t.hashes, 2, 2)
    l1, l2, l3 = (before(leaf.astype(np.uint64), k, 300) for k in (1, 2, 3))
    return np.stack([
        kernel.mix(p1 + U(11)), kernel.mix(p1 * U(31) + p2 + U(12)), kernel.mix(p2 + U(13)), kernel.mix((l1 * U(512) + l2) * U(512) + l3 + U(14)),
    ], 1)


def class_bits(train_tokens: int) -> int:
    """Bits of the rows for classes: eight times the root of the training tokens, between the least and the most."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(8 * math.sqrt(max(1, train_tokens))))))


class Weights:
    """Two hashed tables of rows of 16 weights, for classes and for members (half as many), over the log masses of the leaves."""

    def __init__(self, mass: np.ndarray, bits: int):
        by = mass.reshape(WIDTH, WIDTH)
        self.bits = (bits, bits - 1)
        self.tables = [np.zeros((1 << b, WIDTH), np.float32) for b in self.bits]
        self.bias = np.log(np.maximum(by.sum(1), 1e-13)).astype(np.float32)
        self.bias -= self.bias.max()
        members = np.log(np.maximum(by, 1e-13))
        self.member_bias = (members - members.max(1, keepdims=True)).astype(np.float32)

    def copy(self) -> Weights:
        out = Weights.__new__(Weights)
        out.__dict__ = self.__dict__ | {"tables": [t.copy() for t in self.tables]}
        return out

    def class_rows(self, features: np.ndarray) -> np.ndarray:
        return (features[:, CLASS_FEATURES] >> U(64 - self.bits[0])).astype(np.int64)

    def member_rows(self, features: np.ndarray, of: np.ndarray) -> np.ndarray:
        own = (of.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)
        return ((features[:, MEMBER_FEATURES] ^ own[:, None]) * U(0xD6E8FEB86659FD93) >> U(64 - self.bits[1])).astype(np.int64)

    def log_p(self, which: int, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        table = self.tables[which]
        logits = table.take(rows[:, 0], 0, mode="clip")  # all rows are inside; take copies whole rows, indexing goes by value
        logits += bias
        for k in range(1, rows.shape[1]):
            logits += table.take(rows[:, k], 0, mode="clip")
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits

    def classes(self, features: np.ndarray) -> np.ndarray:
        return self.log_p(0, self.class_rows(features), self.bias)

    def members(self, features: np.ndarray, of: np.ndarray) -> np.ndarray:
        return self.log_p(1, self.member_rows(features, of), self.member_bias[of])


class _Descent:
    """Gradient steps on one task's rows; each row's rate falls with the squared gradients it has had."""

    def __init__(self, start: Weights):
        self.w, self.start = start.copy(), start.tables
        self.tables = self.w.tables
        self.whole = [t.view(f"V{t.itemsize * WIDTH}").ravel() for t in self.tables]  # each row as one value
        self.squares = [np.full(len(t), 1.0, np.float32) for t in self.tables]
        self.times = [np.zeros(len(t), np.int32) for t in self.tables]

    def step(self, which: int, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
        gradient = self.w.log_p(which, rows, bias)
        np.negative(np.exp(gradient, out=gradient), out=gradient)
        gradient[np.arange(len(target)), target] += 1
        # rows with their places in one sorted number: equal rows stay in the order of their places
        placed = np.sort(rows.ravel() << 16 | np.arange(rows.size))
        flat, source = placed >> 16, (placed & 0xFFFF) // rows.shape[1]
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        size = np.diff(first, append=len(flat))
        sums, many = gradient.take(source[first], 0, mode="clip"), np.flatnonzero(size > 1)
        if len(many):
            runs = gradient.take(source[np.repeat(size > 1, size)], 0, mode="clip")
            sums[many] = np.add.reduceat(runs, np.cumsum(size[many]) - size[many], axis=0)
        touched = flat[first]
        squares = self.squares[which].take(touched) + np.einsum("ij,ij->i", sums, sums) / WIDTH
        self.squares[which][touched] = squares
        new = np.einsum("ij,i->ij", sums, np.float32(RATE) / np.sqrt(squares))
        new += self.tables[which].take(touched, 0, mode="clip")
        self.whole[which][touched] = new.view(self.whole[which].dtype).ravel()
        self.times[which][touched] += size

    def learn(self, features: np.ndarray, leaf: np.ndarray) -> None:
        for at in range(0, len(leaf), BATCH):
            f, own = features[at : at + BATCH], leaf[at : at + BATCH]
            of, member = own >> 4, own & 15
            self.step(0, self.w.class_rows(f), self.w.bias, of)
            self.step(1, self.w.member_rows(f, of), self.w.member_bias[of], member)

    def changes(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(shard, rows, how often each had a gradient, change) of each shard of rows that changed."""
        shard = 0
        for table, start, times in zip(self.tables, self.start, self.times):
            for at in range(0, len(table), SHARD_ROWS):
                rows = np.flatnonzero(times[at : at + SHARD_ROWS])
                if len(rows):
                    change = (table[at + rows] - start[at + rows]).astype(np.float16)
                    yield shard, rows.astype(np.uint16).tobytes(), times[at + rows].astype(np.float32).tobytes(), change.tobytes()
                shard += 1


def train(docs: DataFrame, words: Lexicon, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` rounds; each training document is in one round, in whichever task reads it."""
    spark = docs.sparkSession
    weights = Weights(words.mass, class_bits(words.train_tokens))
    shards = [len(t) // SHARD_ROWS for t in weights.tables]
    shared_words = spark.sparkContext.broadcast(words)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def descend(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared_words.value
            task = None
            for batch in batches:
                for block in kernel.blocks(batch.column(0)):
                    t = tokens(block)
                    task = task or _Descent(shared.value)
                    at = own.table.find(t.hashes)
                    leaf = np.where(at >= 0, own.leaves[at], t.tail) if len(own.leaves) else t.tail
                    coin = (kernel.mix(t.hashes ^ (np.arange(len(leaf)).astype(np.uint64) * U(0x9E3779B1))) >> U(11)).astype(np.float64) / (1 << 53)
                    target = np.where(coin < own.rates.of(t.hashes), UNSEEN, leaf)
                    task.learn(_features(t, leaf), target)
            some = list(task.changes()) if task else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), *[pa.array([x[k] for x in some], pa.binary()) for k in (1, 2, 3)]], ["shard", "row", "times", "change"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for shard, rows, times, change in zip(batch.column(0).to_pylist(), *[c.to_pylist() for c in batch.columns[1:]]):
                    total, weight = sums.setdefault(shard, (np.zeros((SHARD_ROWS, WIDTH)), np.zeros(SHARD_ROWS)))
                    rows, times = np.frombuffer(rows, np.uint16).astype(np.int64), np.sqrt(np.frombuffer(times, np.float32).astype(np.float64))
                    total[rows] += times[:, None] * np.frombuffer(change, np.float16).reshape(-1, WIDTH)
                    weight[rows] += times
            for shard, (total, weight) in sums.items():
                mean = (total / np.maximum(weight, 1e-9)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["shard", "mean"])

        share = docs.filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == number).select("text")
        changed = share.mapInArrow(descend, "shard int, row binary, times binary, change binary").repartition(sum(shards), "shard")
        for r in changed.mapInArrow(average, "shard int, mean binary").toLocalIterator():
            which, place = (0, r["shard"]) if r["shard"] < shards[0] else (1, r["shard"] - shards[0])
            weights.tables[which][place * SHARD_ROWS : (place + 1) * SHARD_ROWS] += np.frombuffer(r["mean"], np.float32).reshape(-1, WIDTH)
        shared.destroy()
        release(spark)
    shared_words.destroy()
    return weights


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score(docs: DataFrame, counted: DataFrame, words: Lexicon, weights: Weights) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((words, weights))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        log_mass = np.log(np.maximum(own.mass, 1e-13))
        kept = np.log(np.where(own.counts == 1, 0.5, own.counts.astype(float)))
        base = np.log10(own.counts + 1.0) - own.base_zero
        for batch in batches:
            ids = pc.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
            for block in kernel.blocks(batch.column(1)):
                t = tokens(block)
                n, sizes = len(t.hashes), np.diff(t.bounds)
                text = np.repeat(np.arange(len(block)), sizes)
                at = own.table.find(t.hashes)
                known = at >= 0
                leaf = np.where(known, own.leaves[at], t.tail) if len(own.leaves) else t.tail
                features = _features(t, leaf)
                log_p, unseen = np.zeros(n), np.zeros(n)
                for a in range(0, n, BATCH):
                    f, l = features[a : a + BATCH], leaf[a : a + BATCH]
                    rows = np.arange(len(l))
                    of = w.classes(f)
                    log_p[a : a + BATCH] = of[rows, l >> 4] + w.members(f, l >> 4)[rows, l & 15] - log_mass[l]
                    rare = np.flatnonzero(~known[a : a + BATCH])
                    if len(rare):
                        unseen[a + rare] = of[rare, UNSEEN >> 4] + w.members(f[rare], np.full(len(rare), UNSEEN >> 4))[:, UNSEEN & 15]
                total = lambda v: np.bincount(text, weights=v, minlength=len(block))
                sure = np.where(known, log_p + (kept[at] if len(kept) else 0), 0) / np.log(10)
                sure_base = np.where(known, base[at] if len(base) else 0, 0)
                marks = (kernel.text_hashes(block) ^ kernel.mix(ids[block.first : block.first + len(block)].view(np.uint64))).view(np.int64)
                rare = np.flatnonzero(~known)
                group, back, times = np.unique(np.stack([text[rare].astype(np.uint64), t.hashes[rare]], 1), axis=0, return_inverse=True, return_counts=True) if len(rare) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                back = back.ravel()
                m, of_text = len(group), group[:, 0].astype(np.int64)
                doc_ids = batch.column(0).slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([doc_ids, pa.nulls(m, pa.int64())]), pa.array(np.concatenate([marks, marks[of_text]])),
                    pa.concat_arrays([pa.nulls(len(block), pa.int64()), pa.array(group[:, 1].view(np.int64))]),
                    pa.array(np.concatenate([sizes, times])), pa.array(np.concatenate([total(known).astype(np.int64), np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([total(sure_base), np.zeros(m)])),
                    pa.array(np.concatenate([total(sure), np.bincount(back, weights=log_p[rare], minlength=m) / np.log(10)])),
                    pa.array(np.concatenate([np.zeros(len(block)), np.bincount(back, weights=unseen[rare], minlength=m) / np.log(10)])),
                ], ["doc_id", "mark", "h", "n", "known", "base", "p", "unseen"])

    schema = "doc_id long, mark long, h long, n long, known long, base double, p double, unseen double"
    rows = written(docs.select("doc_id", "text").mapInArrow(scan, schema), "token_scores")
    shared.destroy()
    rare = rows.filter("h is not null").select("h", "mark", "n", "p", "unseen").repartition("h").dropDuplicates(["h", "mark"])
    found = rare.join(counted.select("h", "c"), "h", "left")
    seen = F.col("c").isNotNull()
    parts = found.groupBy("mark").agg(
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - words.base_zero)).alias("more_base"),
        F.sum(F.when(seen, F.col("p") + F.col("n") * F.log10(kept_mass(F.col("c")))).otherwise(F.col("unseen"))).alias("more_p"),
    )
    out = rows.filter("h is null").join(parts, "mark", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"), plus("known", "more_known").alias("n_known"),
        F.lit(words.train_tokens).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("p", "more_p").alias("score"),
    )


def fit_and_score(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Train on the documents that are not held out, score all; see ``score`` for the columns.

    Reads doc_id and text. A null, empty or blank text is one token, its end. Every token of a text counts, however
    long it is; repeated rows count as often as they stand there and score alike. Without training rows every token is
    unseen with probability one. No rows give no rows.
    """
    training = docs.filter(~held_out(F.col("doc_id")))
    counted = count_tokens(training)
    words = lexicon(counted, top)
    return score(docs, counted, words, train(training, words))

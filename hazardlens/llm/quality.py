"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, judged by per-document perplexity.

Half of the trusted documents, by a hash of their id, teach the model, the other half sets the thresholds. Counting,
continuation counts, discounts and interpolation are count tables joined on their context, dealt over shards by that
context. As words outside the ``VOCABULARY`` most frequent ones fall into classes by their shape, a word is ``WORD_BITS``
bits and a trigram one integer. All text of the teaching half counts, with its full histories at any size: the tables are cut
into ranges of trigrams, ordered by the middle word, so all that a trigram's probability needs stands in its range. The
n-grams of the documents are sent there packed, about three bytes each, and what comes back is a sum for each document and range.
Each language's threshold is a quantile of the perplexities of its trusted documents that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens.llm import kernel, packed
from hazardlens.llm.common import written

VOCABULARY = 8000
#: For a model of bounded size, how many of the most frequent words are themselves in a context: first those before the last word but one, then the others.
HISTORIES = ((VOCABULARY, VOCABULARY), (2000, VOCABULARY), (500, VOCABULARY), (125, VOCABULARY), (0, VOCABULARY), (0, 2000), (0, 500), (0, 125), (0, 0))
WORD_BITS = 13
QUANTILE = 0.995
RUN = 1 << 20  # n-grams that a scoring task sorts at once
RANGE_GRAMS, RANGE_ROWS = 1 << 25, 1 << 22  # of documents and of the model in a range, on average
TRI, GAMMA, BI, TEXTS = -1, -2, -3, -4  # kinds of packed rows; a run of n-grams has its number
START, END, SHAPES = 0, 1, 2  # ids; the vocabulary follows the 64 shapes
FIRST_WORD = SHAPES + 64
_LETTERS = np.zeros((5, 256), bool)
_LETTERS[0, 97:123] = _LETTERS[1, 65:91] = _LETTERS[2, 48:58] = _LETTERS[3, 128:] = True
_LETTERS[4] = kernel.NOT_ALNUM & ~np.isin(np.arange(256), [*b" \t\n\r\x0b\x0c.,;:!?'\"()-"])


def _shapes(block: kernel.Block, found: kernel.Words) -> np.ndarray:
    """What kinds of byte a word has: lower, upper, digit, non-ASCII, symbol, and whether it is over 12 bytes."""
    out = np.zeros(len(found.start), np.int64)
    for bit, kind in enumerate(_LETTERS):
        sums = np.zeros(len(block.data) + 1, np.int32)
        np.cumsum(kind[block.data], out=sums[1:])
        out |= (sums[found.end] > sums[found.start]).astype(np.int64) << bit
    return out | ((found.end - found.start > 12).astype(np.int64) << 5)


@dataclass
class Words:
    """The vocabulary as sorted hashes and their ids."""

    hashes: np.ndarray
    ids: np.ndarray

    def of(self, block: kernel.Block) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of a block with two starts before and one end after each text, and the bounds of each text's ids."""
        found = kernel.words(block)
        h = kernel.word_hashes(block, found, lower=False)
        ids = SHAPES + _shapes(block, found)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ids[at], ids)
        n = len(block)
        bounds = found.bounds + 3 * np.arange(n + 1)
        out = np.full(int(bounds[-1]), START, np.int64)
        out[np.arange(len(ids)) + 3 * found.text + 2] = ids
        out[bounds[1:] - 1] = END
        return out, bounds


def _grams(ids: np.ndarray) -> np.ndarray:
    """The trigram that ends at each place, as one integer."""
    out = np.zeros(len(ids), np.int64)
    out[2:] = (ids[:-2] << (2 * WORD_BITS)) | (ids[1:-1] << WORD_BITS) | ids[2:]
    return out


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; what a tiny table leaves undefined is a half of the count."""
    n = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else 0.5 * k
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def _smoothed(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """(gram, p) without the lower order's part, and (context, gamma) with its weight, from (gram, context, c)."""
    d = _discounts(counts)
    discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    totals = counts.groupBy(context).agg(F.sum("c").alias("total"), F.sum(discount).alias("given"))
    p = counts.join(totals, context).select("gram", ((F.col("c") - discount) / F.col("total")).alias("p"))
    return p, totals.select(F.col(context).alias("gram"), (F.col("given") / F.col("total")).alias("p"))


def _histories(shapes: np.ndarray, known: int) -> np.ndarray:
    """For each word id the one that stands for it in a context where only the ``known`` most frequent words are themselves."""
    out = np.arange(1 << WORD_BITS)
    some = np.arange(len(shapes)) >= known
    out[FIRST_WORD : FIRST_WORD + len(shapes)][some] = SHAPES + shapes[some]
    return out


def _coarser(counts: DataFrame, shapes: np.ndarray, known: list[tuple[int, ...]], most: int, name: str) -> tuple[DataFrame, list[np.ndarray]]:
    """(gram, c) with the finest histories that leave about ``most`` rows at most, and these, for the words before the last in order.

    How many rows each choice leaves is estimated for all of them in one pass, so counts are dealt once more only.
    """
    choices = [[_histories(shapes, x) for x in k] for k in known]
    if counts.count() <= most:
        return counts, choices[0]

    def map_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_mapped(grams, maps)) for maps in choices], names)

    names = [f"g{i}" for i in range(len(choices))]
    left = counts.mapInArrow(map_all, ", ".join(f"{n} long" for n in names)).agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    maps = next((m for m, n in zip(choices, names) if left[n] <= most), choices[-1])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mapped(batch.column(0).to_numpy(), maps)), batch.column(1)], ["gram", "c"])

    return written(counts.mapInArrow(merge, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), name), maps


def _mapped(grams: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Grams with the words before the last as ``maps`` tells."""
    mask = (1 << WORD_BITS) - 1
    out = grams & mask
    for i, m in enumerate(reversed(maps), 1):
        out = out | (m[(grams >> (i * WORD_BITS)) & mask] << (i * WORD_BITS))
    return out


@dataclass
class Model:
    words: Words
    histories: list[np.ndarray]
    bi_history: list[np.ndarray]
    tri: tuple[np.ndarray, np.ndarray]
    tri_gamma: tuple[np.ndarray, np.ndarray]
    bi: tuple[np.ndarray, np.ndarray]
    bi_gamma: np.ndarray
    uni: np.ndarray

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(table[0]):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], missing)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last word of each trigram after its first two."""
        mask = (1 << WORD_BITS) - 1
        grams, place = np.unique(grams, return_inverse=True)
        pairs = _mapped(grams & ((1 << (2 * WORD_BITS)) - 1), self.bi_history)
        p = self._get(self.bi, pairs, 0.0) + self.bi_gamma[pairs >> WORD_BITS] * self.uni[grams & mask]
        grams = _mapped(grams, self.histories)
        p = self._get(self.tri, grams, 0.0) + self._get(self.tri_gamma, grams >> WORD_BITS, 1.0) * p
        return np.log(p)[place]


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = table.select("gram", F.col("p").cast("float")).toArrow()
    keys, values = got.column("gram").to_numpy(), got.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _turned(grams: np.ndarray) -> np.ndarray:
    """Trigrams with their first two words in the other order, or back."""
    one = (1 << WORD_BITS) - 1
    return (((grams >> WORD_BITS) & one) << (2 * WORD_BITS)) | ((grams >> (2 * WORD_BITS)) << WORD_BITS) | (grams & one)


@dataclass
class Fitted:
    """The model's tables where they are, its few numbers for each word, and how many n-grams taught it."""

    words: Words
    histories: list[np.ndarray]
    bi_history: list[np.ndarray]
    p3: DataFrame
    g3: DataFrame
    p2: DataFrame
    bi_gamma: np.ndarray
    uni: np.ndarray
    tri_counts: DataFrame

    @cached_property
    def local(self) -> Model:
        """The whole model in this process, for a small one."""
        return Model(self.words, self.histories, self.bi_history, _arrays(self.p3), _arrays(self.g3), _arrays(self.p2), self.bi_gamma, self.uni)

    @property
    def tri(self) -> tuple[np.ndarray, np.ndarray]:
        return self.local.tri

    @property
    def bi(self) -> tuple[np.ndarray, np.ndarray]:
        return self.local.bi

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        return self.local.log_p(grams)

    def ranges(self, grams: int) -> np.ndarray:
        """Where the ranges of turned trigrams begin so that ``grams`` n-grams and the model's rows are spread over them."""
        turned = F.shiftleft(F.shiftright("gram", WORD_BITS).bitwiseAND((1 << WORD_BITS) - 1).cast("long"), WORD_BITS) + F.shiftright("gram", 2 * WORD_BITS)
        bucket = F.shiftright(turned, 7).alias("bucket")  # of 128 first words after one another
        got = self.tri_counts.groupBy(bucket).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow().sort_by("bucket")
        bucket, c, n = (got.column(x).to_numpy().astype(np.int64) for x in ("bucket", "c", "n"))
        if not len(bucket):
            return np.zeros(1, np.int64)
        weight = c / c.sum() * grams / RANGE_GRAMS + 3 * n / RANGE_ROWS
        begins = np.flatnonzero(np.diff(np.floor(np.cumsum(weight)), prepend=0) > 0)
        return np.unique(np.concatenate([[0], bucket[begins] << (WORD_BITS + 7)]))


def _dense(table: tuple[np.ndarray, np.ndarray], missing: float) -> np.ndarray:
    out = np.full(1 << WORD_BITS, missing)
    out[table[0]] = table[1]
    return out


def fit(texts: DataFrame, most_grams: int | None = None) -> Fitted:
    """The model of all ``texts``; without any text every word is as likely as every other.

    Only if ``most_grams`` is given the histories are made coarser until its tables have about so many rows at most.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(0)):
                found = kernel.words(block)
                h, at, n = np.unique(kernel.word_hashes(block, found, lower=False), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(_shapes(block, found)[at])], ["h", "n", "shape"])

    tallied = texts.select("text").mapInArrow(tally, "h long, n long, shape long").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))
    frequent = tallied.orderBy(F.col("n").desc(), "h").limit(VOCABULARY).collect()
    top, shapes = np.array([r["h"] for r in frequent], np.int64).view(np.uint64), np.array([r["shape"] for r in frequent], np.int64)
    order = np.argsort(top)
    words = Words(top[order], (FIRST_WORD + np.arange(len(top)))[order])
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in kernel.blocks(batch.column(0)):
                ids, _ = shared.value.of(block)
                grams, n = np.unique(_grams(ids)[ids != START], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], ["gram", "n"])

    counted = texts.select("text").mapInArrow(trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))
    tri = written(counted, "trigrams")
    pair, one = (1 << (2 * WORD_BITS)) - 1, (1 << WORD_BITS) - 1
    # before a word that follows the start only the start can stand, so there the counts themselves continue
    begins = F.shiftright("gram", WORD_BITS).bitwiseAND(one) == START
    bi = tri.groupBy(F.col("gram").bitwiseAND(pair).alias("gram")).agg(F.sum(F.when(begins, F.col("c")).otherwise(1)).alias("c"))
    bi = written(bi, "bigrams")
    uni = bi.groupBy(F.col("gram").bitwiseAND(one).alias("gram")).agg(F.count("*").alias("c")).withColumn("context", F.lit(0))
    histories, bi_history = [np.arange(1 << WORD_BITS)] * 2, [np.arange(1 << WORD_BITS)]
    if most_grams is not None:
        tri, histories = _coarser(tri, shapes, list(HISTORIES), most_grams, "coarse_trigrams")
        bi, bi_history = _coarser(bi, shapes, [(own,) for own in (VOCABULARY, 2000, 500, 125, 0)], most_grams, "coarse_bigrams")
    tri, bi = (t.withColumn("context", F.shiftright("gram", WORD_BITS)) for t in (tri, bi))
    (p3, g3), (p2, g2), (p1, g1) = _smoothed(tri, "context"), _smoothed(bi, "context"), _smoothed(uni, "context")
    rest = _dense(_arrays(g1), 1.0)[0] / (FIRST_WORD + VOCABULARY)
    return Fitted(words, histories, bi_history, p3, g3, p2, _dense(_arrays(g2), 1.0), _dense(_arrays(p1), 0.0) + rest, tri)


_PACKED = "part int, run long, keys binary, numbers binary"


def _packed_model(model: Fitted, starts: np.ndarray) -> DataFrame:
    """The model's rows packed for each range that asks for them."""
    def rows(kind: int, key: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        # the turned trigrams that need a row: one, those of its context, or those with the pair's first word in the middle
        low = key >> WORD_BITS << (2 * WORD_BITS) if kind == BI else _turned(key << WORD_BITS if kind == GAMMA else key)
        high = low + {TRI: 0, GAMMA: (1 << WORD_BITS) - 1, BI: (1 << 2 * WORD_BITS) - 1}[kind]
        first, last = (np.searchsorted(starts, x, "right") - 1 for x in (low, high))
        times = last - first + 1
        place = np.repeat(np.arange(len(key)), times)
        part = np.repeat(first, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((key[place], part))
        part, place = part[order], place[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        some = list(zip(cuts[:-1], cuts[1:]))
        keys, numbers = [packed.squeezed(np.diff(key[place[a:b]], prepend=0)) for a, b in some], [packed.squeezed(p[place[a:b]]) for a, b in some]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(some), kind)), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())], ["part", "run", "keys", "numbers"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            kinds, keys, p = (np.concatenate(x) for x in zip(*held))
            for kind in np.unique(kinds):
                yield rows(kind, keys[kinds == kind], p[kinds == kind])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
            if size >= RUN:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    tables = [t.select(F.lit(kind).cast("long").alias("kind"), "gram", F.col("p").cast("float").alias("p")) for kind, t in ((TRI, model.p3), (GAMMA, model.g3), (BI, model.p2))]
    return written(tables[0].union(tables[1]).union(tables[2]).mapInArrow(pack, _PACKED), "model")


def perplexities(docs: DataFrame, model: Fitted, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep``, n_tokens (words and one end) and perplexity (null without words) of each row."""
    rows = docs.select(*keep, "text")
    words, bi_gamma, uni, same = model.words, model.bi_gamma, model.uni, np.arange(1 << WORD_BITS)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    starts = model.ranges(size // 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, kept = TaskContext.get().partitionId() << 32, [], []

        def flush() -> pa.RecordBatch:
            grams, text = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(grams)
            grams, text = grams[order], text[order]
            cuts = np.append(np.searchsorted(grams, starts), len(grams))
            some = np.flatnonzero(np.diff(cuts))
            keys = [packed.squeezed(np.diff(grams[cuts[i] : cuts[i + 1]], prepend=0)) for i in some]
            numbers = [packed.squeezed(text[cuts[i] : cuts[i + 1]]) for i in some]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as out:
                for x in kept:
                    out.write_batch(x)
            # what is known of the texts goes by, in parts of its own
            return pa.RecordBatch.from_arrays(
                [pa.array([*some, TEXTS - (run + (run >> 32)) % 4096], pa.int32()), pa.array([run] * (len(some) + 1), pa.int64()), pa.array([*keys, sink.getvalue().to_pybytes()], pa.binary()), pa.array([*numbers, b""], pa.binary())],
                ["part", "run", "keys", "numbers"],
            )

        texts = size = 0
        for batch in batches:
            for block in kernel.blocks(batch.column(len(keep))):
                ids, bounds = words.of(block)
                n = np.diff(bounds) - 2
                held.append((_turned(_grams(ids)[ids != START]), np.repeat(np.arange(texts, texts + len(block), dtype=np.int32), n)))
                own = batch.slice(block.first, len(block))
                kept.append(pa.RecordBatch.from_arrays([*own.columns[: len(keep)], pa.array(n)], [*keep, "n_tokens"]))
                texts, size = texts + len(block), size + int(n.sum())
                if size >= RUN:
                    yield flush()
                    run, held, kept, texts, size = run + 1, [], [], 0, 0
        if texts:
            yield flush()

    def score(group: pa.Table) -> pa.Table:
        runs = group.column("run").to_numpy()
        if group.column("part")[0].as_py() < 0:
            return group

        def table(kind: int) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(runs == kind)
            if not len(at):
                return np.zeros(0, np.int64), np.zeros(0, np.float32)
            keys = np.concatenate([np.cumsum(packed.unsqueezed(group.column("keys")[i], np.int64)) for i in at])
            order = np.argsort(keys)
            return keys[order], np.concatenate([packed.unsqueezed(group.column("numbers")[i], np.float32) for i in at])[order]

        own = Model(words, [same, same], [same], table(TRI), table(GAMMA), table(BI), bi_gamma, uni)
        at, texts, sums = np.flatnonzero(runs >= 0), [], []
        for i in at:
            grams = np.cumsum(packed.unsqueezed(group.column("keys")[int(i)], np.int64))
            text = packed.unsqueezed(group.column("numbers")[int(i)], np.int32)
            first = np.flatnonzero(np.diff(grams, prepend=-1))
            logs = np.repeat(own.log_p(_turned(grams[first])), np.diff(first, append=len(grams)))
            some = np.bincount(text) > 0
            texts.append(packed.squeezed(np.diff(np.flatnonzero(some), prepend=0)))
            sums.append(np.bincount(text, logs)[some].tobytes())
        return pa.table({"part": group.column("part").take(pa.array(at)), "run": runs[at], "keys": pa.array(texts, pa.binary()), "numbers": pa.array(sums, pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # equal texts get equal sums
        with pa.ipc.open_stream(group.column("keys")[0].as_buffer()) as stored:
            texts = stored.read_all()
        logs = np.zeros(len(texts))
        for keys, sums in zip(group.column("keys")[1:], group.column("numbers")[1:]):
            logs[np.cumsum(packed.unsqueezed(keys, np.int64))] += np.frombuffer(sums.as_buffer(), np.float64)
        n = texts.column("n_tokens").to_numpy()
        return texts.append_column("perplexity", pa.array(np.exp(-logs / n), mask=n <= 1))

    scored = _packed_model(model, starts).union(rows.mapInArrow(send, _PACKED)).groupBy("part").applyInArrow(score, _PACKED)
    schema = StructType(rows.schema.fields[: len(keep)]).add("n_tokens", "long").add("perplexity", "double")
    return scored.groupBy("run").applyInArrow(total, schema)


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("quality"), doc_id), F.lit(2))


def _limits(docs: DataFrame, labels: DataFrame, trusted_docs: int | None, quantile: float) -> tuple[DataFrame, DataFrame]:
    """The scores of all documents, with a hash of their text as key, and (of, own, limit): the threshold of each language and of all."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select("doc_id").distinct()
    half = _half(F.col("doc_id")) == 0
    teachers, others = good.filter(half), good.filter(~half)
    if trusted_docs is not None:
        teachers = teachers.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id").limit(trusted_docs)
        others = good.join(teachers, "doc_id", "left_anti")
    texts = written(docs.select("doc_id", "text").filter(half).join(teachers, "doc_id", "left_semi").select("text"), "trusted")
    model = fit(texts)
    scored = written(perplexities(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")), model, ("doc_id", "lang", "key")), "perplexities")
    unseen = scored.join(others, "doc_id", "left_semi").filter("perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = unseen.groupBy("lang").agg(limit.alias("own"))
    languages = scored.select("lang").distinct().join(F.broadcast(unseen.agg(limit.alias("limit"))), how="left")
    b = by_lang.withColumnRenamed("lang", "of")
    return scored, written(languages.join(b, F.col("lang").eqNullSafe(F.col("of")), "left").select(F.col("lang").alias("of"), "own", "limit"), "limits")


def _judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    threshold = F.coalesce("own", "limit")
    accepted = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.withColumns({"threshold": threshold, "accepted": accepted}).drop("of", "own", "limit")


def classify(docs: DataFrame, labels: DataFrame, trusted_docs: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, accepted): one row for each row of ``docs``.

    Trusted are documents labelled quality = 1 and not toxic = 1. Half of them, by a hash of doc_id, teach the model (with
    ``trusted_docs`` only so many); the ``quantile`` of all others' perplexities in a language is its threshold, of
    all languages together where a language (null is one) has none. Accepted is a perplexity up to the threshold.
    A null, empty or blank text has no perplexity and is rejected; without trusted rows nothing else is rejected.
    Repeated rows are judged alike. Only doc_id, text and lang are read, and doc_id, quality and toxic of ``labels``.
    """
    scored, limits = _limits(docs, labels, trusted_docs, quantile)
    return _judged(scored, limits).drop("key")


def accept(docs: DataFrame, labels: DataFrame, trusted_docs: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with all their columns; a text and its language decide for all their rows."""
    scored, limits = _limits(docs, labels, trusted_docs, quantile)
    rejected = _judged(scored, limits).filter(~F.col("accepted")).select(F.col("key").alias("_key"), F.col("lang").alias("_lang")).distinct()
    return docs.join(rejected, (F.xxhash64(docs["text"]) == rejected["_key"]) & docs["lang"].eqNullSafe(rejected["_lang"]), "left_anti")

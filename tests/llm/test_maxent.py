from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hazardlens.llm import kernel, maxent
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame, lower, sample, words


def brute(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    texts = [[*words(lower(t or "")), None] for _, t in rows]
    counts = Counter(w for t, h in zip(texts, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
    return [(d, h, len(t), sum(counts[w] > 0 for w in t), n, base(t)) for (d, _), h, t in zip(rows, held, texts)]


@pytest.mark.parametrize("which,top", [("sample", maxent.TOP), ("sample", 300), ("odd", maxent.TOP), ("odd", 3), ("empty", 10)])
def test_counts_and_base_against_brute_force(spark, small, which, top):
    rows = {"sample": [r[:2] for r in sample(small)], "odd": [r[:2] for r in ODD], "empty": []}[which]
    got = sorted(maxent.fit_and_score(docs_frame(spark, rows), top).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r["base_score"] for r in got] == pytest.approx([w[5] for w in want])
    assert all(r["score"] <= 1e-6 for r in got)


@pytest.mark.parametrize("top", [3, 2000])
def test_scores_do_not_depend_on_where_counts_are(spark, small, top):
    docs = docs_frame(spark, [r[:2] for r in sample(small)], extra=False)
    whole, part = ({r["doc_id"]: r["score"] for r in maxent.fit_and_score(docs, t).collect()} for t in (maxent.TOP, top))
    assert part == pytest.approx(whole, rel=1e-6)


def test_unseen_rates_are_half_of_the_counts_of_one(spark, small):
    counted = maxent.count_tokens(docs_frame(spark, [r[:2] for r in sample(small)]))
    c = {r["h"]: r["c"] for r in counted.collect()}
    cells = lambda bits: np.array(list(c), np.int64).view(np.uint64) & np.uint64((1 << bits) - 1)
    for most in (15, maxent.RATE_BITS):  # many tokens in a cell, and few
        rates = maxent.unseen_rates(counted, 1 if most == 15 else len(c), most)
        sums, ones = np.zeros(1 << rates.bits), np.zeros(1 << rates.bits)
        np.add.at(sums, cells(rates.bits).astype(int), list(c.values()))
        np.add.at(ones, cells(rates.bits).astype(int), [0.5 * (n == 1) for n in c.values()])
        assert np.abs(rates.values / 255 - ones / np.maximum(sums, 1)).max() < 1 / 255


def test_rows_of_weights_grow_with_the_training_tokens():
    bits = [maxent.class_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**10)]
    assert bits == sorted(bits) and bits[0] == maxent.LEAST_BITS and len(set(bits)) >= 4


def test_unseen_leaf_is_learnt_from_context(spark):
    """After "name" stands a new word each time, after "the" the same one: a new word is likelier after "name"."""
    rows = [(i, f"the house name q{i}x the house name z{i}y the house") for i in range(3000)]
    docs = docs_frame(spark, rows, extra=False)
    test = [(10**6 + i, t) for i in range(200) for t in ("the house name neverseen", "the neverseen name house") if zlib.crc32(str(10**6 + i).encode()) % 7 == 2]
    got = maxent.fit_and_score(docs.union(docs_frame(spark, test, extra=False))).filter("doc_id >= 1000000").select("score").toPandas()
    assert len(set(got.score.round(6))) == 2 and got.score.max() - got.score.min() > 1


def test_outcomes_sum_to_one(spark, small):
    docs = docs_frame(spark, [r[:2] for r in sample(small)])
    counted = maxent.count_tokens(docs)
    words_ = maxent.lexicon(counted)
    w = maxent.train(docs, words_, rounds=1)
    assert any(np.abs(t).max() > 0 for t in w.tables)
    t = maxent.tokens(next(kernel.blocks(pa.array(["The and of this"]))))
    at = words_.table.find(t.hashes)
    f = maxent._features(t, np.where(at >= 0, words_.leaves[at], t.tail))
    of = np.exp(w.classes(f))
    leaf = np.concatenate([of[:, [c]] * np.exp(w.members(f, np.full(len(f), c))) for c in range(16)], 1)
    kept = np.where(words_.counts == 1, 0.5, words_.counts)
    share = np.bincount(words_.leaves, weights=kept / words_.mass[words_.leaves], minlength=256)
    share[maxent.UNSEEN] = 1
    assert leaf.sum(1) == pytest.approx(np.ones(len(f)), abs=1e-4)
    assert (leaf * share).sum(1) == pytest.approx(np.ones(len(f)), abs=1e-3)


def test_query_beats_the_base_on_held_out_text(spark, small):
    out = queries()["op3_maxent_lm"](spark, small.replace("sf0.001", "sf0.01")).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > 0.95 * held.base_score.sum()

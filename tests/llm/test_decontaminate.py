from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import decontaminate
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame, lower, sample

RUN = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def tokens(text):
    return RUN.findall(lower(text or ""))


def smith_waterman(item, passage):
    best, row = 0, [0] * (len(passage) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(passage):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def edited(words, r, edits):
    w = list(words)
    for _ in range(edits):
        at = r.randrange(len(w))
        w[at : at + 1] = r.choice([[], ["zzz"], [w[at], "extra"]])
    return w


@pytest.fixture(scope="module")
def case():
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 50)))) for i in range(12)] + [(90, "two words"), (91, ""), (92, None), (93, "...")]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 150)))) for i in range(40)]
    for i, (_, text) in enumerate(items[:12]):
        for edits in (0, 1, len(text.split()) // 8):
            body = r.choices(vocabulary, k=30) + edited(text.split(), r, edits) + r.choices(vocabulary, k=20)
            docs.append((100 + len(docs), ", ".join(body).upper()))
    return docs + [(800, "has Two, WORDS here"), (801, items[0][1] + " q " * 3000 + items[0][1])] + [r[:2] for r in ODD], items


def test_copies_and_edits_against_full_alignment(spark, case):
    docs, items = case
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "key", "score")})
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["item_words"]) for r in decontaminate.leaks(docs_frame(spark, docs), b).collect()}
    want = {}
    for d, text in docs:
        w = tokens(text)
        for i, t in items:
            item = tokens(t)
            # an item of one or two words is a seed of its own, so all of it has to stand in the passage
            if item and w and (s := smith_waterman(item, w)) >= (len(item) if len(item) > 2 else 2 * len(item)):
                want[d, i] = (s, len(item))
    assert got == want
    assert len(want) > 36


def test_a_slice_at_a_time(spark, case, monkeypatch):
    docs, items = case
    whole = sorted(map(tuple, decontaminate.leaks(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 2000)
    assert sorted(map(tuple, decontaminate.leaks(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())) == whole


@pytest.mark.parametrize("every", [4, 5])
def test_one_edit_in_each_stretch_and_no_verbatim_copy(spark, every):
    r = random.Random(every)
    item = [f"w{i}" for i in range(59)]
    copies = [[f"x{d}" if i % every == d % every else w for i, w in enumerate(item)] for d in range(every)]
    # other documents hold some of the intact n-grams, so these are not the rarest
    docs = [(d, " ".join(c)) for d, c in enumerate(copies[:1])] + [(10 + i, " ".join([*r.choices(item, k=20), *item[a : a + 3]])) for i, a in enumerate(range(0, 57, 2))]
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.leaks(docs_frame(spark, docs), b).collect()}
    assert got == {0: smith_waterman(item, copies[0])} and got[0] >= 59
    # a stretch of n-grams that are all too frequent keeps the rarest that occurs
    found, places, _ = decontaminate._seeds(docs_frame(spark, docs).select("text"), decontaminate._item_words(pa.array([" ".join(item)])))
    assert len(found.keys) == len(places) > 20


def test_frequent_grams_leave_one_in_each_stretch(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEW_DOCS", 1)
    item = [f"w{i}" for i in range(20)]
    docs = [(i, " ".join(item)) for i in range(30)] + [(90, "only w3 w4 w5 w6 here")]
    found, places, _ = decontaminate._seeds(docs_frame(spark, docs).select("text"), decontaminate._item_words(pa.array([" ".join(item)])))
    assert sorted({p // decontaminate.STRIDE for x in places for _, p in x}) == list(range(6)) and len(found.keys) == 6


def test_align_is_smith_waterman():
    r = np.random.default_rng(1)
    for _ in range(200):
        item, passage = r.integers(1, 6, r.integers(1, 12)).astype(np.uint64), r.integers(1, 6, r.integers(1, 20)).astype(np.uint64)
        best, end = decontaminate.align(item, passage[None, :], np.array([len(passage)]))
        assert best[0] == smith_waterman(item.tolist(), passage.tolist())


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs_frame(spark, [(1, "a b c")]), none).collect() == []
    assert decontaminate.leaks(docs_frame(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_query(spark, small):
    assert queries()["op2_decontamination"](spark, small).filter("coverage < 0.5").count() == 0
    assert sample(small)

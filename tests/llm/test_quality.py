from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import kernel, quality
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame, words

VOCAB = [f"w{i}" for i in range(40)]


def corpus(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [r.choice(VOCAB)]
        while len(w) < r.randint(2, 30):
            w.append(VOCAB[(VOCAB.index(w[-1]) + r.choice([1, 1, 2, 7])) % 40])
        out.append(" ".join(w))
    return out


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney from its formulas; returns log p of a text's words and end."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *words(t), "</s>"]
        tri.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    bi = Counter()
    for (u, v, w), c in tri.items():
        bi[v, w] += c if v == "<s>" else 1
    uni = Counter(w for _, w in bi)

    def level(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2, 0.05), k - 0.05) for k in (1, 2, 3)]
        total, given = Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            given[g[:-1]] += d[min(c, 3) - 1]
        return lambda ctx, w, lower: ((max(0, counts[ctx + (w,)] - d[min(counts[ctx + (w,)], 3) - 1]) if counts[ctx + (w,)] else 0) + given[ctx] * lower) / total[ctx] if total[ctx] else lower

    p3, p2, p1 = level(tri), level(bi), level(Counter({(w,): c for w, c in uni.items()}))

    def log_p(t):
        w = ["<s>", "<s>", *words(t), "</s>"]
        out = 0
        for i in range(2, len(w)):
            p = p1((), w[i], 1 / (quality.FIRST_WORD + quality.VOCABULARY))
            out += math.log(p3(tuple(w[i - 2 : i]), w[i], p2((w[i - 1],), w[i], p)))
        return out

    return log_p


def test_model_against_its_formulas(spark):
    texts = corpus(1, 200)
    model = quality.fit(docs_frame(spark, list(enumerate(texts))))
    log_p = kneser_ney(texts)
    for t in corpus(2, 50):
        block = next(kernel.blocks(pa.array([t])))
        ids, _ = model.words.of(block)
        got = model.log_p(quality._grams(ids)[ids != quality.START]).sum()
        assert got == pytest.approx(log_p(t), rel=1e-4)


def test_probabilities_sum_to_one(spark):
    model = quality.fit(docs_frame(spark, list(enumerate(corpus(3, 100)))))
    every = np.concatenate([[quality.END], np.arange(quality.SHAPES, quality.FIRST_WORD + quality.VOCABULARY)])
    for context in (0, quality.FIRST_WORD, (quality.FIRST_WORD << quality.WORD_BITS) | (quality.FIRST_WORD + 3)):
        total = np.exp(model.log_p((context << quality.WORD_BITS) | every)).sum()
        assert total == pytest.approx(1, abs=2e-3)


def test_decisions_and_odd_rows(spark):
    good = [(1000 + i, t, "en") for i, t in enumerate(corpus(4, 300))]
    bad = [(5000 + i, " ".join(f"{w}%%%" for w in reversed(t.split())), "en") for i, t in enumerate(corpus(5, 50)) if len(t.split()) > 5]
    odd = [(r[0], r[1], None) for r in ODD]
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good[:200]] + [(d, 0, 0) for d, *_ in bad[:10]] + [(None, 1, 0), (good[0][0], 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs_frame(spark, good + bad + odd), labels).collect()
    assert len(out) == len(good) + len(bad) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert sum(by[d]["accepted"] for d, *_ in good) >= 0.95 * len(good)
    assert not any(by[d]["accepted"] for d, *_ in bad)
    for d in (1, 2, 3):
        assert by[d]["perplexity"] is None and by[d]["n_tokens"] == 1 and not by[d]["accepted"]


def test_every_trusted_row_that_does_not_teach_counts_for_its_threshold(spark):
    ids = spark.range(1, 200).withColumn("half", quality._half(F.col("id"))).withColumn("at", F.xxhash64(F.lit("sample"), F.col("id"))).orderBy("at", "id").collect()
    teaching, other = [r["id"] for r in ids if r["half"] == 0][:10], [r["id"] for r in ids if r["half"] == 1][:20]
    texts = corpus(6, 30)
    docs = [(d, t, "xx") for d, t in zip(teaching, texts)] + [(d, t, "en") for d, t in zip(other, texts[10:])]
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in docs], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(docs_frame(spark, docs), labels, trusted_docs=3, quantile=1.0).collect()}
    for lang, counted in (("xx", teaching[3:]), ("en", other)):
        assert {r["threshold"] for r in out.values() if r["lang"] == lang} == {max(out[d]["perplexity"] for d in counted)}


def test_all_trusted_rows_of_the_teaching_half_are_read(spark, monkeypatch):
    """More of them than the model once took."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts: seen.append(texts.count()) or fit(texts))
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 5) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert quality.classify(docs, labels).count() == 20_000
    assert seen == [docs.filter(quality._half(F.col("doc_id")) == 0).count()] and seen[0] > 8000


def test_coarser_histories_keep_all_counts_and_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(quality, "HISTORIES", ((8000, 8000), (10, 8000), (10, 10)))
    texts = docs_frame(spark, list(enumerate(corpus(8, 300))))
    fine, coarse = quality.fit(texts), quality.fit(texts, 150)
    assert len(coarse.tri[0]) < len(fine.tri[0]) and len(coarse.bi[0]) <= len(fine.bi[0])
    every = np.concatenate([[quality.END], np.arange(quality.SHAPES, quality.FIRST_WORD + quality.VOCABULARY)])
    for context in (0, quality.FIRST_WORD + 30, ((quality.FIRST_WORD + 30) << quality.WORD_BITS) | (quality.FIRST_WORD + 3)):
        assert np.exp(coarse.log_p((context << quality.WORD_BITS) | every)).sum() == pytest.approx(1, abs=2e-3)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["accepted"] for r in quality.classify(docs_frame(spark, [(1, "a b"), (2, "")]), labels).orderBy("doc_id").collect()] == [True, False]
    assert quality.classify(docs_frame(spark, []), labels).collect() == []


def test_query_keeps_clean_documents(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    out = queries()["op4_quality_classifier"](spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 1].accepted.mean() >= 0.97
    assert out[out.quality == 0].accepted.mean() <= 0.35


@pytest.fixture
def whole(monkeypatch):
    """No table may be made coarser; small ranges and runs, as of a large corpus."""
    monkeypatch.setattr(quality, "_coarser", None)
    for name, n in (("RANGE_GRAMS", 400), ("RANGE_ROWS", 200), ("RUN", 300)):
        monkeypatch.setattr(quality, name, n, raising=False)


def test_perplexities_are_those_of_the_whole_model(spark, whole):
    docs = [(i, t, "en") for i, t in enumerate(corpus(9, 300))] + [(900, "a %% B", "en"), (901, "", "en"), (902, None, "en"), (903, "a %% B", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    frame = docs_frame(spark, docs)
    teachers = {r["doc_id"] for r in frame.filter(quality._half(F.col("doc_id")) == 0).collect()} & set(range(300))
    log_p = kneser_ney([t for d, t, _ in docs if d in teachers])
    out = {r["doc_id"]: r for r in quality.classify(frame, labels).collect()}
    for d, t, _ in docs[:300]:
        n = len(words(t)) + 1
        assert out[d]["n_tokens"] == n and out[d]["perplexity"] == pytest.approx(math.exp(-log_p(t) / n), rel=1e-4)
    assert out[900]["perplexity"] == out[903]["perplexity"] is not None
    assert out[901]["perplexity"] is None and out[902]["perplexity"] is None


def test_accepted_rows_are_those_of_the_whole_model(spark, whole):
    docs = [(i, t, "en") for i, t in enumerate(corpus(10, 200))] + [(500 + i, " ".join(f"{w}%" for w in t.split()), None) for i, t in enumerate(corpus(11, 30))]
    frame = docs_frame(spark, docs + docs[:3] + docs[-3:] + [(7, docs[-1][1], "en"), (None, docs[0][1], None), (600, None, "en")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    plain = lambda rows: sorted(((r["doc_id"], r["lang"], r["text"]) for r in rows), key=str)
    judged = quality.classify(frame.withColumn("doc_id", F.col("doc_id")), labels)
    ok = {(r["doc_id"], r["lang"], r["n_tokens"], r["perplexity"]) for r in judged.filter("accepted").collect()}
    kept = quality.accept(frame, labels)
    assert kept.columns == frame.columns and 150 < len(ok)
    assert plain(kept.collect()) == plain(r for r in frame.collect() if any(r["doc_id"] == d and r["lang"] == lang and len(words(r["text"])) + 1 == n for d, lang, n, _ in ok))

from __future__ import annotations

import random

import pandas as pd
import pytest

import corpus_pipeline
from hazardlens.llm import mixing
from hazardlens.llm.queries import TARGETS
from tests.llm.helpers import docs_frame, words
from tests.llm.test_decontaminate import smith_waterman, tokens
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_mixing import simulated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, near copies, leaks, secrets and odd rows; and its labels and benchmark."""
    r = random.Random(11)
    vocabulary = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(r.expovariate(0.08)))] for _ in range(n))
    items = [(i, " ".join(r.choices(vocabulary, k=25))) for i in range(5)]
    rows = [(i, text(r.randint(20, 90))) for i in range(160)]
    rows += [(1000 + i, rows[i][1] + (" word1 word2" if i % 2 else "")) for i in range(0, 40)]
    rows += [(2000 + i, f"{text(20)} {items[i % 5][1]} {text(20)}") for i in range(10)]
    rows += [(3000 + i, f'{text(30)} password="hunter{i}22" {text(5)}') for i in range(8)]
    rows += [(4000 + i, " ".join(f"{w}%%%{i}" for w in reversed(text(30).split()))) for i in range(12)]
    rows += [(5000, None), (5001, ""), (None, text(40)), (160, rows[0][1]), (160, rows[0][1])]
    path = tmp_path_factory.mktemp("corpus")
    full = [(d, t, "en", None if d == 7 else f"src{(d or 0) % 4}") for d, t in rows]
    docs_frame(spark, full, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 0 if 4000 <= d < 5000 else 1, 0) for d in [*range(150), 4000, 4001]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Each stage's rows, each written and read again."""
    path, _ = folder
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    out["start"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.toPandas()
        if name != "mixing":
            assert sorted(docs.columns) == sorted(COLUMNS)
    return out


def rows(df):
    return [(None if pd.isna(d) else int(d), t) for d, t in zip(df.doc_id, df.text)]


def test_quality(stages):
    kept, start = rows(stages["quality"]), rows(stages["start"])
    assert not any(d and 4000 <= d < 5002 for d, _ in kept)
    clean = [x for x in start if not (x[0] and x[0] >= 4000)]
    assert len(kept) >= 0.97 * len(clean)


def test_near_copies(stages):
    before, after = rows(stages["quality"]), rows(stages["near_copies"])
    own = {r[0]: r[2] for r in linked([(i, t) for i, (_, t) in enumerate(before)], 5, 80, 100)}
    groups = {}
    for i, row in enumerate(before):
        groups.setdefault(own[i], []).append(row)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(after, key=str) == sorted(want, key=str)
    assert len(after) < len(before) - 30


def test_decontamination(stages, folder):
    clean = lambda t: all(smith_waterman(tokens(i), tokens(t)) < len(tokens(i)) for _, i in folder[1])
    before, after = rows(stages["near_copies"]), rows(stages["decontamination"])
    assert sorted(after, key=str) == sorted([x for x in before if clean(x[1])], key=str)
    assert len(before) - len(after) >= 8


def test_secrets(stages):
    before, after = dict(rows(stages["decontamination"])), dict(rows(stages["secrets"]))
    assert set(before) == set(after)
    for d, t in after.items():
        assert "hunter" not in t
        assert ("hunter" in before[d]) == ("[SECRET]" in t) and (t == before[d] or "hunter" in before[d])
    assert all(len(t) == n for t, n in zip(stages["secrets"].text, stages["secrets"].n_chars))


def test_mixing(stages):
    out = stages["mixing"].sort_values("position")
    assert list(out.position) == list(range(len(out)))
    assert sorted(rows(out), key=str) == sorted(rows(stages["secrets"]), key=str)
    named = [s if s in TARGETS else mixing.OTHER for s in out.source]
    sizes = pd.Series(named).value_counts().to_dict()
    order = [s for _, s in sorted(set(zip(out.slot, named)))]
    assert order == simulated(TARGETS, {s: -(-n // mixing.BLOCK_ROWS) for s, n in sizes.items()})


def test_run_equals_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder[0]).toPandas()
    key = ["position", "doc_id", "text"]
    assert got.sort_values("position")[key].astype(str).values.tolist() == stages["mixing"].sort_values("position")[key].astype(str).values.tolist()
    assert words("a b")

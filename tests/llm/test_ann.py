from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import ann
from hazardlens.llm.queries import queries


def brute(rows, k=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = {}
            for i, w in good:
                if i != q and len(w) == len(v):
                    scored[i] = max(scored.get(i, -np.inf), float((np.array(w, float) * np.array(v, float)).sum()))
            out.setdefault(q, []).append(sorted(((-s, i) for i, s in scored.items()))[:k])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hit = total = 0
    for q, (best, *_) in want.items():
        ranks, ids, scores = zip(*got[q])
        assert ranks == tuple(range(1, len(best) + 1)) and len(set(ids)) == len(ids)
        assert list(zip([-s for s in scores], ids)) == sorted(zip([-s for s in scores], ids))
        total += len(best)
        least = -best[-1][0]
        hit += sum(s >= least - 1e-9 for s in scores)
    return hit / total


@pytest.mark.parametrize("nodes", [4096, 100])
def test_recall_against_brute_force(spark, small, nodes, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_NODES", nodes)
    monkeypatch.setattr(ann, "QUERY_GROUP", 8)
    table = pd.read_parquet(f"{small}/embeddings.parquet")
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(table.vec_id, table.embedding)]
    got = found(ann.search(spark.read.parquet(f"{small}/embeddings.parquet"), F.col("vec_id") % 20 == 0))
    assert recall(got, brute(rows)) >= 0.95


def test_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=24) * rng.lognormal()).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(ann.search(df, F.col("vec_id") % 20 == 0)), brute(rows)) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]),
            (20, [2.0, 1.0]), (40, [1.0, 2.0, 3.0])] + [(100 + i, [0.25, 0.25]) for i in range(60)] + [(60, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("dim", "shard", "ids", "part")})
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert {q: [(i, s) for _, i, s in v] for q, v in got.items()} == {q: [(i, -s) for s, i in v[0]] for q, v in want.items() if v[0]}


def test_ties_go_to_the_smaller_ids_of_all_that_tie(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, 0.01 * ((i * 37) % 59)]) for i in range(1, 60) if i % 20] + [(i + 1000, [0.5, -0.01 * i]) for i in (20, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(1, 22) if i != 20] and {r["score"] for r in got} == {0.5}


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_query(spark, small):
    assert queries()["op5_ann_hnsw"](spark, small).count() == 20 * 25

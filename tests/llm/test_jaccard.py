from __future__ import annotations

import random

import pytest

from hazardlens.llm import common, jaccard_join, packed, sketch
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame, lower, sample, words


def brute(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = words(lower(text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    post: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in post[g] if j > i}:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    ids: dict = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def edited(seed: int, n: int = 40) -> list[tuple]:
    """Groups of near copies with few or many edits, shared passages and exact copies."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = r.choices(vocabulary, k=30)
    rows = []
    for g in range(n):
        first = r.choices(vocabulary, k=r.randint(1, 120)) + (shared if g % 3 == 0 else [])
        for _ in range(r.randint(1, 5)):
            w = list(first)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary).upper()
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("which,width,num", [("odd", 3, 90), ("sample", 3, 90), ("edited", 3, 90), ("edited", 5, 80), ("edited", 2, 60), ("empty", 3, 90)])
def test_components_against_brute_force(spark, small, which, width, num, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)  # so clusters take several blocks
    monkeypatch.setattr(jaccard_join, "ROW_WEIGHT", 200)
    rows = {"odd": [r[:2] for r in ODD] * 2, "sample": [r[:2] for r in sample(small)], "edited": edited(width), "empty": []}[which]
    got = sorted((tuple(r)[:4] for r in jaccard_join.link(docs_frame(spark, rows), width, num, 100).collect()), key=str)
    assert got == brute(rows, width, num, 100)


def test_query(spark, small):
    rows = [r[:2] for r in sample(small)]
    got = sorted((tuple(r) for r in queries()["op10_jaccard_join"](spark, small).collect()), key=str)
    assert got == brute(rows, 3, 90, 100)
    assert any(c != d for d, _, c, _ in got)


def test_one_of_each(spark):
    rows = edited(7) + [r[:2] for r in ODD] * 2 + [(None, "q r s t u v w"), (None, "q r s t u v w")]
    out = jaccard_join.one_of_each(docs_frame(spark, rows), 3, 90)
    assert out.columns == docs_frame(spark, rows).columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    parts = {}
    for i, n, c, _ in brute([(i, t) for i, (_, t) in enumerate(rows)], 3, 90, 100):
        if n:
            parts.setdefault(c, set()).add(rows[i])
    assert len(got) == len(set(got)) and len([g for g in got if words(g[1])]) == len(parts)
    for members in parts.values():
        (stays,) = members & set(got)
        assert stays[0] == min((d for d, _ in members if d is not None), default=None)
    assert {g for g in got if not words(g[1])} == {r for r in rows if not words(r[1])}



def test_components_deal_edges_three_times_a_round(spark, monkeypatch):
    """Every exchange of a round costs the driver a thread and a stage; a long path needs many rounds."""
    exchanges, kept = [], common.written

    def written(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return kept(df, name)

    monkeypatch.setattr(common, "written", written)
    r = random.Random(4)
    nodes = list(range(80))
    r.shuffle(nodes)
    edges = [*zip(nodes[:30], nodes[1:31]), *[(nodes[40], n) for n in nodes[41:60]], (nodes[61], nodes[60]), (nodes[60], nodes[61]), (nodes[5], nodes[5])]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = [nodes[:31], nodes[40:60], nodes[60:62]]
    assert got == {n: min(g) for g in groups for n in g}
    assert len(exchanges) > 2 and max(exchanges[1:]) <= 3


def test_chance_repeats_make_no_clusters_at_any_size(spark, monkeypatch):
    """As in a corpus far larger than any table of counts that is broadcast: shingles shared by chance stay out of the prefixes."""
    edges, own = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda e: edges.append(e.count()) or own(e))
    monkeypatch.setattr(sketch, "bits_for", lambda *a: 6)
    r = random.Random(9)
    rows = [(i, " ".join(r.choices([f"w{i}" for i in range(45)], k=60))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(10)]
    got = sorted((tuple(x)[:4] for x in jaccard_join.link(docs_frame(spark, rows), 3, 90, 100).collect()), key=str)
    assert got == brute(rows, 3, 90, 100) and sum(n for *_, n in got) >= 20
    assert 10 <= edges[0] <= 150


@pytest.mark.parametrize("width,num", [(3, 90), (2, 60)])
def test_many_groups_and_runs(spark, monkeypatch, width, num):
    monkeypatch.setattr(packed, "GROUP", 50)
    monkeypatch.setattr(packed, "FLUSH", 300)
    rows = edited(11) + [r[:2] for r in ODD]
    got = sorted((tuple(x)[:4] for x in jaccard_join.link(docs_frame(spark, rows), width, num, 100).collect()), key=str)
    assert got == brute(rows, width, num, 100)

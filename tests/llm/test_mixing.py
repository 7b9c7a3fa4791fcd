from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardlens.llm import mixing
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame, sample


def simulated(weights, blocks):
    """Slot by slot with fractions: earliest deadline among released blocks; a new phase when a source runs out."""
    order, left, phase, t = [], dict(blocks), {}, 0
    live = None
    while any(left.values()):
        now = {s: w for s, w in weights.items() if left.get(s)}
        if now != live:
            live, phase, t = now, dict.fromkeys(now, 0), 0
        total = sum(live.values())
        ready = [(-(-(phase[s] + 1) * total // w), s) for s, w in live.items() if phase[s] * total // w <= t]
        _, s = min(ready)
        order.append(s)
        phase[s] += 1
        left[s] -= 1
        t += 1
    return order


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 9), min_size=1), st.lists(st.integers(0, 40), min_size=6, max_size=6))
def test_phases_equal_a_simulation(weights, counts):
    blocks = dict(zip("abcdef", counts))
    blocks = {s: blocks[s] for s in weights}
    got = {}
    for p in mixing.phases(weights, blocks):
        for s, w in p["weights"].items():
            for k in range(p["share"][s]):
                got[p["base"] + k // w * p["total"] + p["slots"][s][k % w]] = s
    assert [got[i] for i in range(len(got))] == simulated(weights, blocks)


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 30), min_size=1))
@settings(max_examples=200, deadline=None)
def test_deviation_is_less_than_one_block(weights):
    total, slots = sum(weights.values()), mixing.period(weights)
    for s, w in weights.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - t * w / total) < 1
        for k, x in enumerate(slots[s]):
            assert k * total // w <= x < -(-(k + 1) * total // w)


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_every_row_once_in_order(spark, small, which):
    rows = {"odd": [(*r, "en", None if i % 2 else "src1") for i, r in enumerate(ODD)] * 2, "sample": sample(small)}[which]
    weights = {"src1": 5, "src2": 3, "src0": 1, mixing.OTHER: 4}
    out = sorted(mixing.mix(docs_frame(spark, rows), weights, block_rows=3).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(rows)))
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    slots = sorted({(r["slot"], r["mix_source"]) for r in out})
    sizes = {s: sum((r[3] if r[3] in weights else "*") == s for r in rows) for s in weights}
    assert [s for _, s in slots] == simulated(weights, {s: -(-n // 3) for s, n in sizes.items() if n})
    assert all(b["slot"] > a["slot"] or b["place"] == a["place"] + 1 for a, b in zip(out, out[1:]))


def test_empty_and_bad_weights(spark):
    assert mixing.mix(docs_frame(spark, []), {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs_frame(spark, []), {"a": 0})


def test_query(spark, small):
    out = queries()["op7_pfair_mixing"](spark, small).collect()
    assert sorted(r["position"] for r in out) == list(range(200))

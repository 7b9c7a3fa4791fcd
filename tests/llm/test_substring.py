from __future__ import annotations

import hashlib

import pytest

from hazardlens.llm import substring_dedup
from tests.llm.helpers import ODD, docs_frame, sample, words


def brute(rows, width=13):
    first: dict[tuple, int] = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        cut = [False] * len(w)
        for i in range(len(w) - width + 1):
            at = first.get(tuple(w[i : i + width]))
            if at is not None and (doc is None or at < doc):
                cut[i : i + width] = [True] * width
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((doc, len(w), sum(cut), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "sample", "empty", "same ids"])
def test_windows_against_brute_force(spark, small, which):
    rows = {"odd": [r[:2] for r in ODD], "sample": [r[:2] for r in sample(small)], "empty": [], "same ids": [(1, t) for _, t, *_ in ODD] + [(2, t) for _, t, *_ in ODD]}[which]
    out = substring_dedup.dedup(docs_frame(spark, rows))
    got = sorted([tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()], key=str)
    assert got == brute(rows)


def test_query_digest(spark, small):
    from hazardlens.llm.queries import queries

    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries()["op9_substring_dedup"](spark, small).collect()}
    assert got == {d: (n, c, hashlib.sha256(k.encode()).hexdigest()) for d, n, c, k in brute([r[:2] for r in sample(small)])}

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hazardlens.llm import url_filter
from tests.conftest import plan

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("Example.ORG", "/en/1", "allow"),
    ("a.example.org", "/en/", "allow"), ("com", "", "block"), ("b.com", "/x", "allow"), (None, "/", "block"), ("x", None, "block"), ("y", "/", "maybe"),
]
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "ftp://a.b.example.org/en/123?q#f", "http://example.org/es/", "http://example.org/ES/",
    "http://notexample.org/es/", "http://a.example.org/en/1", "http://com", "http://xcom/", "http://b.com/xy", "http://c.b.com/", "http://b.com?/x", "http://b.com#/x",
    "http://user@b.com/x", "http://b.com:80/x", "http://b.com./x", "x://y://z.org/", "http://.org/", "http://a..org/\n/", "http://é.org/É", "http://" + "s." * 3000 + "org/" + "p/" * 60000,
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([rest.find(c, cut) for c in "?#" if c in rest[cut:]], default=len(rest))
    path = rest[cut:end]
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in ((h.lower(), p, v) for h, p, v in rules if h and p is not None and v in ("allow", "block"))
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").withColumns(
        {c: F.lit(c) for c in ("host", "verdict", "p0", "a_host", "f_path", "prefix", "full", "k", "have", "dotted.name")}
    )
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = url_filter.judge(pages, table)
    assert out.columns == ["page_id", "url", "p0", "a_host", "f_path", "prefix", "full", "k", "have", "dotted.name", *url_filter.RESULTS]
    return {r["page_id"]: tuple(r[c] for c in url_filter.RESULTS) for r in out.collect()}, out


@pytest.mark.parametrize("rules", [RULES, [], RULES[:1]])
def test_rules_against_brute_force(spark, rules):
    got, _ = judged(spark, URLS, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_many_random_rules_shuffled(spark):
    rnd = random.Random(3)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    path = lambda: "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randint(0, 4)))
    rules = [(host(), path(), rnd.choice(url_filter.VERDICTS)) for _ in range(80)]
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{host()}{path()}?{rnd.random()}" for _ in range(300)] + ["http://a.b/x"] * 200
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, out = judged(spark, urls, rules)
        assert "SortMergeJoin" in plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_allowed_keeps_every_column(spark):
    pages = spark.createDataFrame([(1, "http://com/a", "h"), (2, "http://net/", "h"), (3, None, None), (2, "http://net/", "h")], "`a.b` int, url string, host string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    out = url_filter.allowed(pages, rules)
    assert out.columns == ["a.b", "url", "host"]
    assert sorted(map(tuple, out.collect()), key=str) == [(2, "http://net/", "h"), (2, "http://net/", "h"), (3, None, None)]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id int, url string")
    assert url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect() == []


def test_no_python_and_only_the_url_is_hashed(spark, small):
    from hazardlens.llm.queries import queries

    shown = plan(queries()["op11_url_filter"](spark, small))
    assert "Python" not in shown and "Arrow" not in shown and "html" not in shown

"""Members of one array of large documents, with files cut at every kind of place."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from hazardlens.plans import queries as registered
from hazardlens.plans import views
from hazardlens.sources import feeds, members


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n) for n in names}

    def cut(size, batch=7):
        for n, v in zip(names, (size, 1, batch)):
            spark.conf.set(n, str(v))

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, path, member="features"):
    return sorted(r["value"] for r in members.read_members(spark, str(path), member).collect())


ODD = [
    {"id": "a}b", "t": "}{][\"\\"}, {"id": "c", "deep": [[{"x": {"y": "}}}"}}], {}]}, {}, {"id": "\\\\", "e": "\\\"}"}, {"k}": 1, "features": [{"id": "inner"}]},
    {"long": "}" * 90}, {"slashes": "\\" * 41, "q": "\"" * 7}, {"ü": "日本 }"},
]


def cut_by_hand(files: list[str], member: str, splits: int, rnd: random.Random, batch: int) -> list[str]:
    """The reader's steps on text that is cut at random braces, without Spark."""
    batches, at = [], []
    for f, text in enumerate(files):
        pieces = [p + "}" for p in text.split("}")]
        pieces = pieces[:-1] if pieces[-1] == "}" else pieces
        starts = sorted({0, *(rnd.randrange(max(1, len(pieces))) for _ in range(splits))})
        at += [(f, max(s for s in starts if s <= i), p) for i, p in enumerate(pieces)]
    for i in range(0, len(at), batch):
        part = at[i : i + batch]
        batches.append(pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.string())], ["file", "start", "value"]))
    summaries = [r for b in members._summaries(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    out, chain = [], None
    for split, kind, text in members._found(batches, members._beginnings(summaries), member):
        if kind == "whole":
            out.append(text.decode())
        elif kind == "begin":
            chain = text
        else:
            chain += text
            if kind == "end":
                out.append(chain.decode())
    return sorted(json.dumps(json.loads(v), sort_keys=True) for v in out)


DOCUMENTS = [
    {"metadata": {"features": {"no": [1]}, "n": [{"id": "no"}]}, "bbox": [1, 2], "features": ODD * 3, "others": [{"id": "no"}]},
    {"fea}tures": [{"id": "no"}], "features": [[{"id": "no"}], 1, "}{", None, ODD[0], [], ODD[1]], "x": [{"id": "no"}]},
    {"features": []}, {"events": ODD}, [{"features": [{"id": "no"}]}],
]
FILES = [json.dumps(d, indent=i, ensure_ascii=i is None) for d in DOCUMENTS for i in (None, 1)] + [
    "\n".join(json.dumps({"features": [m, m]}) for m in ODD[:3]), '{"features": [{"id": "whole"}, {"id": "half", "p": {"q": 1}, "r": [', "", "}",
]
WANTED = sorted(json.dumps(m, sort_keys=True) for m in (ODD * 3 + ODD[:2]) * 2 + [m for m in ODD[:3] for _ in range(2)] + [{"id": "whole"}])


@pytest.mark.parametrize("seed", range(25))
def test_members_at_random_cuts(seed):
    rnd = random.Random(seed)
    assert cut_by_hand(FILES, "features", rnd.randrange(200), rnd, rnd.choice([1, 3, 50, 10**6])) == WANTED


VALUES = st.recursive(st.text('{}[]"\\:, aé', max_size=8) | st.integers() | st.none(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text('}{"a\\', max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.integers(0, 30), st.integers(0, 10**6))
def test_any_document(value, splits, seed):
    doc = {"pre": value, "rows": [value, *({"v": value, "n": i} for i in range(4)), value, [value]], "post": [value, {"rows": [value]}]}
    want = sorted(json.dumps(m, sort_keys=True) for m in doc["rows"] if isinstance(m, dict))
    assert cut_by_hand([json.dumps(doc)], "rows", splits, random.Random(seed), 3) == want


def test_members_of_files_that_spark_cuts(spark, tmp_path, small_splits):
    for i, text in enumerate(FILES):
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    small_splits(1500, 20)
    assert sorted(json.dumps(json.loads(v), sort_keys=True) for v in read(spark, tmp_path)) == WANTED
    assert len(read(spark, tmp_path, "events")) == 2 * len(ODD)


def test_one_file_is_many_tasks_and_rows_are_those_of_the_whole_document(spark, tmp_path, small_splits):
    rnd = random.Random(1)
    features = [
        {"id": f"q{i}", "properties": {"mag": i / 7, "place": rnd.choice(["9km } of Port, Land", "Ridge \"{\"", None]), "time": 1704067200000 + i, "url": "u" * rnd.randint(0, 90)},
         "geometry": {"coordinates": [i / 100, -i / 100, 7]}}
        for i in range(3000)
    ]
    (tmp_path / "q.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    whole = rows(feeds.quake_rows(feeds.read_geojson(spark, str(tmp_path))))
    small_splits(1 << 16, 500)
    split = feeds.quake_rows(feeds.read_geojson_split(spark, str(tmp_path)))
    assert split.rdd.getNumPartitions() >= 8
    assert rows(split) == whole and len(whole) == 3000


def test_registered_query_with_cuts_in_every_file(spark, small, small_splits):
    want = rows(registered.queries()["ingest_geojson"](spark, small))
    small_splits(16384, 100)
    assert rows(registered.queries()["ingest_geojson_split"](spark, small)) == want


def test_a_collection_is_one_whole_document_however_its_rows_are_coalesced(spark, tmp_path):
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    before = {n: spark.conf.get(n) for n in own}
    docs = [(json.dumps({"features": [{"id": f"{d}-{i // 2}", "t": "x" * 50}] * (1 + i % 2)}), d) for d in range(12) for i in range(200)]
    try:
        for n, v in own.items():
            spark.conf.set(n, v)
        views.collection_files(spark.createDataFrame(docs, "value string, day int").repartition(4), "features", str(tmp_path / "days"))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    files = list(tmp_path.glob("days/*/*.txt"))
    assert len(files) == 12
    assert all(len(json.loads(f.read_text())["features"]) == 300 for f in files)
    assert len(read(spark, tmp_path / "days")) == 3600


def test_natural_events_split(spark, tmp_path, small_splits):
    docs = {"events": [{"id": str(i), "title": "t}", "categories": [{"title": "a"}, {}], "geometry": [{"date": "2024-01-01T00:00:00Z", "coordinates": [1, 2]}]} for i in range(50)]}
    (tmp_path / "e.json").write_text(json.dumps(docs))
    whole = rows(feeds.natural_event_rows(feeds.read_natural_events(spark, str(tmp_path))))
    small_splits(1000)
    assert rows(feeds.natural_event_rows(feeds.read_natural_events_split(spark, str(tmp_path)))) == whole

"""Landed feed payloads to messages: each id once, across files, restarts and broken documents."""

from __future__ import annotations

import json

import pytest
from conftest import rows

from hazardlens import schemas
from hazardlens.streaming import jobs, publish, sinks


def document(*ids, **props):
    features = [{"id": i, "properties": {"mag": 1.0, "place": "Ridge", "time": 0} | props, "geometry": {"coordinates": [1, 2]}} for i in ids]
    return json.dumps({"type": "FeatureCollection", "features": features}, indent=1)


def drain(spark, folder, out, horizon=publish.HORIZON):
    events = publish.quake_events(publish.payload_stream(spark, str(folder / "in"), max_files=1), horizon)
    sinks.finish(publish.start_publish(events, str(folder / "c"), str(folder / out), trigger=jobs.DRAIN, name=jobs._own_name("p"), columns=("id", "place")))
    return rows(spark.read.parquet(str(folder / out)), "key", "value")


def test_each_id_once_over_polls_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(document("a", "b", "a"))
    (tmp_path / "in" / "2.json").write_text(document("b", "c"))
    (tmp_path / "in" / "3.json").write_text('{"features": [')
    (tmp_path / "in" / "4.json").write_text(document(None))
    message = lambda i: (i, f'{{"id":"{i}","place":"Ridge"}}')
    assert drain(spark, tmp_path, "out") == [message(i) for i in "abc"]
    assert drain(spark, tmp_path, "out") == [message(i) for i in "abc"]
    (tmp_path / "in" / "5.json").write_text(document("c", "d", "a", time=-10**12))  # old when it first shows
    assert drain(spark, tmp_path, "out") == [message(i) for i in "abcd"]


def test_state_is_forgotten_behind_the_horizon(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    for i, (ids, at) in enumerate([("a", 1_000), ("a", 1_100), ("b", 9_000), ("c", 9_050), ("a", 9_100)]):
        (tmp_path / "in" / f"{i}.json").write_text(document(*ids))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + at,) * 2)
    assert [k for k, _ in drain(spark, tmp_path, "out", "10 minutes")] == ["a", "a", "b", "c"]


def test_unreadable_documents_are_listed(spark):
    payloads = spark.createDataFrame([('{"features": []}',), ("{",), ('{"other": 1}',), (None,)], "value string")
    assert rows(publish.unreadable(payloads, schemas.GEOJSON)) == [("{",), ('{"other": 1}',)]


def test_where_to_publish(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = publish.natural_events(publish.payload_stream(spark, str(tmp_path / "in")))
    with pytest.raises(ValueError):
        publish.start_publish(events, "c")
    with pytest.raises(ValueError):
        publish.start_publish(events, "c", path="p", servers="s", to_topic="t")

"""Feed files and topic messages with their odd rows."""

from __future__ import annotations

import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from hazardlens import schemas
from hazardlens.functions import times
from hazardlens.sources import feeds, tables, topic


def test_geojson_file(spark, tmp_path):
    def feature(i, **p):
        props = {"mag": 5.04, "place": "9km W of Port, Land", "time": 1704067200123, "url": "u", "type": "earthquake", "status": "s", "magType": "ml"}
        return {"id": i, "properties": props | p, "geometry": {"coordinates": [10.5, -3.25, 7]}}

    doc = {"features": [feature("a"), feature("a"), feature("b", mag=None, place=None), feature("c", place="Ridge")]}
    (tmp_path / "q.geojson").write_text(json.dumps(doc, indent=1))
    out = feeds.quake_rows(feeds.read_geojson(spark, str(tmp_path)))
    got = rows(out, "id", "time", "magnitude", "place", "latitude", "longitude", "city", "country", "shown_magnitude")
    time = dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    first = ("a", time, 5.04, "9km W of Port, Land", -3.25, 10.5, "Port", "Land", 5.0)
    assert got == [first, first, ("b", time, None, "Unknown location", -3.25, 10.5, "Unknown", "Unknown", 0.0),
                   ("c", time, 5.04, "Ridge", -3.25, 10.5, "Ridge", "Ridge", 5.0)]


def test_fire_csv_file_by_header_name_and_rejects(spark, tmp_path):
    lines = [
        "frp,acq_time,latitude,longitude,extra,acq_date",
        "12.5,5,40.00000,-100.00000,x,2024-01-01",
        "3,930,0,20,x,2024-01-01",
        ",0005,1,2,x,2024-01-01",
        "7,2460,1,2,x,2024-01-01",
        "7,1200,1,2,x,",
        "abc,1200,1,2,x,2024-01-01",
        "7,12345,1,2,x,2024-01-01",
        "7,1200,north,2,x,2024-01-01",
    ]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    raw = feeds.read_fire_csv(spark, str(tmp_path / "f.csv"))
    good = rows(feeds.fire_rows(raw), "id", "time", "frp", "city")
    assert good == [
        ("0_20_2024-01-01_930", dt.datetime(2024, 1, 1, 9, 30), 3.0, "Africa"),
        ("40.00000_-100.00000_2024-01-01_5", dt.datetime(2024, 1, 1, 0, 5), 12.5, "North America"),
    ]
    reasons = sorted(r[0] for r in feeds.fire_rejects(raw).select("reason").collect())
    assert reasons == [
        "acquisition date or time missing", "acquisition time unreadable", "acquisition time unreadable",
        "coordinate not a number", "coordinate or power missing", "power not a number",
    ]


def test_natural_events(spark, tmp_path):
    first = {"date": "2024-01-01T00:00:00Z", "coordinates": [1.0, 2.0]}
    last = {"date": "2024-01-03T06:00:00Z", "coordinates": [10.125, -20.5]}
    polygon = {"date": "2024-01-04T00:00:00Z", "coordinates": [[[1, 2], [3, 4]]]}
    events = [
        {"id": "a", "title": "T", "link": "L", "categories": [{"title": "Storms"}, {"title": "Floods"}], "geometry": [first, last]},
        {"id": "b", "categories": [], "geometry": [polygon]},
        {"id": "c", "title": "C"},
        {"title": "no id", "geometry": [first | {"coordinates": [1.0]}]},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"events": events}))
    out = feeds.natural_event_rows(feeds.read_natural_events(spark, str(tmp_path)))
    got = {r["id"]: r for r in out.collect()}
    assert got["a"]["location"] == "-20.50, 10.13" and got["a"]["type"] == "Storms, Floods"
    assert got["a"]["from_date"] == dt.datetime(2024, 1, 1) and got["a"]["last_modified"] == dt.datetime(2024, 1, 3, 6)
    assert got["b"]["location"] == "N/A" and got["b"]["event_name"] == "N/A" and got["b"]["type"] == ""
    assert got["c"]["last_modified"] is None and got["c"]["url"] == "N/A"
    assert got["unknown"]["location"] == "N/A"


def test_messages(spark):
    def message(**fields):
        return json.dumps(fields)

    values = [
        message(id="a", time="2024-01-01 10:00:00", frp=7.5, latitude="12.5", longitude="-3.25"),
        message(id="b", time="soon", frp="n/a", latitude=1.0, longitude=2.0),
        message(time="2024-01-01 10:00:00", frp=1.0),
        "{broken",
    ]
    now = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(v, now) for v in values], "value string, timestamp timestamp")
    got = rows(topic.decode_messages(raw, schemas.FIRE_MESSAGE), "id", "time", "frp", "latitude", "longitude")
    assert got == [("a", dt.datetime(2024, 1, 1, 10), 7.5, 12.5, -3.25), ("b", None, None, 1.0, 2.0)]
    reasons = sorted(r["reason"] for r in topic.message_rejects(raw, schemas.FIRE_MESSAGE).collect())
    assert reasons == ["no readable id", "no readable id", "time unreadable"]


def test_incremental_load_and_mark(spark):
    incoming = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 3)), ("c", None)],
        "id string, last_modified timestamp_ntz",
    )
    loaded = incoming.filter("id = 'a'")
    new = feeds.new_rows_only(incoming, loaded)
    assert rows(new) == [("b", dt.datetime(2024, 1, 3)), ("c", None)]
    mark = feeds.high_water_mark(new).first()
    assert mark["high_water_mark"] == dt.datetime(2024, 1, 3) and mark["row_count"] == 2
    bound = feeds.high_water_mark(loaded).select("high_water_mark").scalar()
    assert {r["id"] for r in feeds.since(incoming, bound).collect()} == {"a", "b", "c"}


def test_event_table_prunes_by_type_and_date(spark, tmp_path):
    events = spark.createDataFrame(
        [("1", "fire", dt.datetime(2024, 1, 1)), ("2", "earthquake", dt.datetime(2024, 1, 2))], "id string, type string, time timestamp_ntz"
    )
    tables.write_events(events, str(tmp_path / "t"))
    back = tables.read_events(spark, str(tmp_path / "t")).filter("type = 'fire'")
    assert rows(back, "id") == [("1",)]
    assert "PartitionFilters: [isnotnull(type" in back._jdf.queryExecution().executedPlan().toString()


def test_times_with_an_offset(spark):
    texts = ["2024-01-01T12:00:00+02:00", "2024-01-01 12:00:00Z", "2024-01-01T12:00:00.25-0130", "2024-01-01 12:00:00", "2024-01-01", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    noon = dt.datetime(2024, 1, 1, 12)
    hour = dt.timedelta(hours=1)
    got = [r[0] for r in df.orderBy("i").select(times.utc_from_text(F.col("t"))).collect()]
    assert got == [noon - 2 * hour, noon, noon + 1.5 * hour + dt.timedelta(milliseconds=250), noon, dt.datetime(2024, 1, 1), None, None]


def test_csv_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,frp\n1,2,2024-01-01,0130,5\n")
    (tmp_path / "b.csv").write_text("frp,acq_time,acq_date,longitude,latitude,confidence\n7,,2024-01-02,4,3,high\n")
    raw = feeds.read_fire_csv(spark, str(tmp_path))
    assert rows(feeds.fire_rows(raw), "latitude", "longitude", "frp") == [(1.0, 2.0, 5.0)]
    full = feeds.fire_rows(raw, id_prefix="fire_", missing_clock="0000")
    assert rows(full, "id", "time", "frp") == [("fire_1_2_2024-01-01_0130", dt.datetime(2024, 1, 1, 1, 30), 5.0), ("fire_3_4_2024-01-02_0000", dt.datetime(2024, 1, 2), 7.0)]


def test_feed_documents_a_line_each(spark, tmp_path):
    line = '{"features": [{"id": "%s", "properties": {"mag": 1.0, "time": 0}, "geometry": {"coordinates": [1, 2]}}]}'
    (tmp_path / "x.json").write_text("\n".join(line % i for i in "ab"))
    assert rows(feeds.quake_rows(feeds.read_geojson(spark, str(tmp_path), lines=True)), "id") == [("a",), ("b",)]

"""Streams against the batch operators: several files, restarts, replays, output modes."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hazardlens import params, schemas
from hazardlens.operators import alerts, events, metrics
from hazardlens.plans import views
from hazardlens.sources import topic
from hazardlens.streaming import jobs, ordered, sinks

NOW = {"availableNow": True}
FAR = dt.datetime(2030, 1, 1)


def land(spark, df, folder, parts):
    """Write rows as files in time order; file names and times both sort."""
    schema = df.schema
    ordered = df.orderBy("time").collect()
    size = -(-len(ordered) // parts)
    for n in range(parts):
        chunk = spark.createDataFrame(ordered[n * size : (n + 1) * size], schema)
        chunk.coalesce(1).write.mode("append").parquet(str(folder))


def stream_of(spark, folder, schema):
    return jobs.watermarked(topic.file_stream(spark, str(folder), schema, max_files=1))


@pytest.fixture(scope="module")
def live(spark, small):
    return views.events(spark, small).filter("time < TIMESTAMP_NTZ'2024-01-08 00:00:00'")


def sentinel(spark, schema):
    values = {"id": "end", "type": "fire", "time": FAR, "severity": "Unknown"}
    return spark.createDataFrame([tuple(values.get(n) for n in schema.names)], schema)


def test_metrics_stream_equals_batch(spark, live, tmp_path):
    land(spark, live, tmp_path / "in", 3)
    land(spark, sentinel(spark, live.schema), tmp_path / "in", 1)
    out = jobs.run_metrics(stream_of(spark, tmp_path / "in", live.schema))
    batch = metrics.window_metrics(live)
    for c in ("window_start", "window_end"):
        out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    assert rows(out) == rows(batch)


def test_alert_stream_equals_batch_and_survives_a_restart(spark, live, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    half = live.filter("time < TIMESTAMP_NTZ'2024-01-04 00:00:00'")
    rest = live.filter("time >= TIMESTAMP_NTZ'2024-01-04 00:00:00'")
    for part in (half, rest):
        land(spark, part, folder, 2)
        marked = stream_of(spark, folder, live.schema)
        sinks.finish(jobs.start_alerts(marked, table, checkpoint, cooldown_seconds=7200, trigger=NOW))
    assert rows(spark.read.parquet(table).drop("batch_id")) == rows(alerts.alerts(live, 7200))


def test_dedupe_across_batches_and_restart(spark, live, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    one_hour = live.filter("time < TIMESTAMP_NTZ'2024-01-02 00:00:00'").withColumn("time", F.date_trunc("hour", F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz"))
    for _ in range(2):
        land(spark, one_hour, folder, 2)
        sinks.finish(jobs.start_ingest(stream_of(spark, folder, live.schema), table, checkpoint, trigger=NOW))
    written = spark.read.parquet(table)
    assert rows(written, "id") == rows(one_hour, "id")
    assert {"type", "event_date", "batch_id"} <= set(written.columns)


def test_ingest_fills_places_per_batch(spark, tmp_path):
    data = [("a", "fire", dt.datetime(2024, 1, 1), 0.1, 0.1, "P", "Low", None, 1.0, None, "Given"), ("b", "fire", dt.datetime(2024, 1, 1), 60.0, 0.1, "P", "Low", None, 1.0, None, None)]
    df = spark.createDataFrame(data, schemas.HAZARD_EVENT)
    gaz = spark.createDataFrame([(1, 0.0, 0.0, "C", None, None, "X")], "place_id long, lat double, lon double, city string, town string, village string, country string")
    land(spark, df, tmp_path / "in", 1)
    stream = stream_of(spark, tmp_path / "in", df.schema)
    sinks.finish(jobs.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), gazetteer=gaz, trigger=NOW))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "city", "country") == [("a", "C", "Given"), ("b", "Unknown", "Unknown")]


def test_messages_to_events(spark, small, tmp_path):
    h = views.hazard(spark, small)
    folders = {}
    for kind in ("earthquake", "fire"):
        folders[kind] = tmp_path / kind
        views.messages(h, kind).write.parquet(str(folders[kind]))
    schema = "value string, timestamp timestamp_ntz"
    quake, fire = (spark.readStream.schema(schema).parquet(str(folders[k])) for k in ("earthquake", "fire"))
    out = jobs.run_dedupe(jobs.event_stream(quake, fire))
    expected = views.events_of(h)
    assert rows(out, "id", "type", "severity") == rows(expected, "id", "type", "severity")
    assert out.filter("type = 'earthquake' AND city IS NULL").count() == 0


def test_comma_places_and_three_title_grades(spark, tmp_path):
    quake = json.dumps({"id": "q", "time": "2024-01-01 00:00:00", "magnitude": 7.5, "place": "9km W of Port, Land"})
    bare = json.dumps({"id": "r", "time": "2024-01-01 00:00:00", "magnitude": 4.0, "place": "Ridge"})
    fire = json.dumps({"id": "f", "time": "2024-01-01 00:00:00", "frp": 80.0, "city": "C"})
    timeless = json.dumps({"id": "g", "time": "soon", "frp": 80.0})
    streams = []
    for name, values in {"quake": [quake, bare], "fire": [fire, timeless]}.items():
        spark.createDataFrame([(v, FAR) for v in values], "value string, timestamp timestamp").write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema("value string, timestamp timestamp").parquet(str(tmp_path / name)))
    out = jobs.run_dedupe(jobs.event_stream(*streams, params.QUAKE_GRADES_3_TITLE, params.FIRE_GRADES_3_TITLE, comma_places=True))
    assert rows(out, "id", "severity", "city", "country") == [
        ("f", "High", "C", None), ("q", "High", "9km W of Port", "Land"), ("r", "Moderate", "Ridge", None),
    ]


def test_late_rows_are_dropped(spark, live, tmp_path):
    folder = tmp_path / "in"
    early = live.filter("time < TIMESTAMP_NTZ'2024-01-02 00:00:00'")
    for _ in range(2):  # a late row is dropped by the watermark of the batch before its own
        land(spark, sentinel(spark, live.schema), folder, 1)
    land(spark, early, folder, 1)
    assert jobs.run_metrics(stream_of(spark, folder, live.schema)).count() == 0


def test_batch_folder_replay_changes_nothing(spark, live, tmp_path):
    write = sinks.batch_folders(str(tmp_path / "t"))
    write(live, 0)
    write(live, 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == live.count()


@pytest.mark.parametrize("mode", ["json", "parquet", "cells", "console"])
def test_output_modes(spark, live, tmp_path, mode, capfd):
    land(spark, live, tmp_path / "in", 1)
    stream = stream_of(spark, tmp_path / "in", live.schema)
    out = str(tmp_path / "out")
    sinks.finish(sinks.writer(stream, mode, None if mode == "console" else out, str(tmp_path / "c"), f"mode_{mode}", NOW, F.col("id"), F.col("time")).start())
    if mode == "json":
        assert {json.loads(r[0])["id"] for r in spark.read.text(out).collect()} == {r[0] for r in rows(live, "id")}
    elif mode == "parquet":
        assert rows(spark.read.parquet(out), "id") == rows(live, "id")
    elif mode == "cells":
        assert spark.read.parquet(out).select("key").distinct().count() == live.count()
    with pytest.raises(ValueError):
        sinks.writer(stream, "hbase", out, out, "x", NOW, F.col("id"), F.col("time"))


def test_several_queries_in_one_session(spark, live, tmp_path):
    land(spark, live, tmp_path / "in", 1)
    marked = stream_of(spark, tmp_path / "in", live.schema)
    started = [
        jobs.start_metrics(marked, str(tmp_path / "m"), str(tmp_path / "mc"), trigger=NOW, name="m"),
        jobs.start_alerts(marked, str(tmp_path / "a"), str(tmp_path / "ac"), trigger=NOW, name="a"),
    ]
    jobs.await_any(spark)
    for q in started:
        sinks.finish(q)
    assert rows(spark.read.parquet(str(tmp_path / "a")).drop("batch_id")) == rows(alerts.alerts(live))


def messages(spark, folder, *batches):
    """One file of JSON messages per batch, in order."""
    for batch in batches:
        values = [(json.dumps(m), FAR) for m in batch]
        spark.createDataFrame(values, "value string, timestamp timestamp").coalesce(1).write.mode("append").parquet(str(folder))
    return topic.file_stream(spark, str(folder), spark.createDataFrame([], "value string, timestamp timestamp").schema, max_files=1)


def at(clock):
    return f"2024-01-01 {clock}:00"


def test_a_lagging_feed_loses_nothing(spark, tmp_path):
    quakes = messages(spark, tmp_path / "q", *[[{"id": f"q{i}", "time": at(f"12:0{i}"), "magnitude": 5}] for i in range(3)])
    fires = messages(spark, tmp_path / "f", *[[{"id": f"f{i}", "time": at(f"09:{i}0"), "frp": 5}] for i in range(3)])
    out = jobs.run_dedupe(jobs.event_stream(quakes, fires))
    assert rows(out, "id") == [(f"{k}{i}",) for k in "fq" for i in range(3)]


def test_good_and_rejected_are_what_was_sent(spark, tmp_path):
    quakes = messages(spark, tmp_path / "q", [{"id": "a", "time": at("12:00"), "magnitude": "NaN"}, {"id": None, "time": at("12:00")}], [{"id": "b", "time": "soon"}])
    fires = messages(spark, tmp_path / "f", [{"id": "c", "time": "2024-01-01T14:00:00+02:00", "frp": 1e25}, "text"], [{"id": "d", "time": at("12:00"), "frp": "Infinity"}])
    started = jobs.start_all(quakes, fires, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger=NOW)
    for q in started:
        sinks.finish(q)
    good = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert rows(good, "id", "magnitude", "frp") == [("a", None, None), ("c", None, 1e25), ("d", None, None)]
    assert {r["time"].hour for r in good.collect()} == {12}
    bad = rows(spark.read.parquet(str(tmp_path / "out" / "rejects")), "topic", "reason")
    assert bad == [("earthquake", "no readable id"), ("earthquake", "number not finite"), ("earthquake", "time unreadable"), ("fire", "no readable id"), ("fire", "number not finite")]


@pytest.mark.parametrize("mode", ["console", "json", "parquet", "cells"])
@pytest.mark.parametrize("job", ["ingest", "metrics", "alerts"])
def test_every_job_in_every_mode(spark, live, tmp_path, mode, job):
    land(spark, live.filter("time < TIMESTAMP_NTZ'2024-01-03 00:00:00'"), tmp_path / "in", 1)
    land(spark, sentinel(spark, live.schema), tmp_path / "in", 1)
    marked = stream_of(spark, tmp_path / "in", live.schema)
    start = {"ingest": jobs.start_ingest, "metrics": jobs.start_metrics, "alerts": jobs.start_alerts}[job]
    out = None if mode == "console" else str(tmp_path / "out")
    sinks.finish(start(marked, out, str(tmp_path / "c"), mode=mode, trigger=NOW, name=f"{job}_{mode}"))
    if mode == "json":
        assert spark.read.json(out).count() > 0
    elif mode != "console":
        assert spark.read.parquet(out).count() > 0


def test_table_prunes_after_a_replay_and_compacts(spark, live, tmp_path):
    write = sinks.batch_folders(str(tmp_path / "t"), by=("type", "event_date"))
    dated = live.withColumn("event_date", F.to_date("time"))
    for _ in range(2):
        write(dated.filter("type = 'fire'"), 0)
        write(dated.filter("type <> 'fire'"), 1)
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == live.count()
    day = table.filter("type = 'fire' AND event_date = DATE'2024-01-02'")
    assert day.count() == live.filter("type = 'fire' AND to_date(time) = DATE'2024-01-02'").count()
    assert all("type=fire/event_date=2024-01-02" in f for f in day.inputFiles()) or "PartitionFilters: [isnotnull(type" in day._jdf.queryExecution().toString()
    sinks.compact(spark, str(tmp_path / "t"), str(tmp_path / "c"), ("type", "event_date"))
    assert rows(spark.read.parquet(str(tmp_path / "c")), "id", "type") == rows(live, "id", "type")


def test_cooldown_of_zero_and_below(spark, live, tmp_path):
    land(spark, live, tmp_path / "in", 2)
    out = jobs.run_alerts(stream_of(spark, tmp_path / "in", live.schema), 0)
    assert rows(out) == rows(alerts.alerts(live, 0)) == rows(alerts.alerts(live, 1))
    assert out.count() == alerts.alert_candidates(live).select("alert_key", F.date_trunc("second", "time")).distinct().count()
    with pytest.raises(ValueError):
        alerts.alerts(live, -1)


def test_kafka_source_is_only_built_where_its_connector_is(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        topic.topic_stream(spark, "localhost:9092", "fires")


def test_publish_round_trip(spark, live):
    sent = topic.to_messages(live.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss")).filter("type = 'fire'"))
    back = topic.decode_messages(sent.withColumn("timestamp", F.current_timestamp()), schemas.FIRE_MESSAGE)
    fires = live.filter("type = 'fire'")
    assert rows(back, "id", "frp", "latitude", "city") == rows(fires, "id", "frp", "latitude", "city")


def test_events_as_of_is_a_subquery(spark, live):
    assert events.time_range(live, events.latest_time(live), "12h").count() > 0


def test_alert_state_does_not_grow(spark, live, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ckpt"
    sizes = []
    for start in range(1, 6):
        part = live.filter(f"day(time) = {start}")
        land(spark, part, folder, 2)
        sinks.finish(jobs.start_alerts(stream_of(spark, folder, live.schema), table, str(checkpoint), cooldown_seconds=7200, trigger=NOW))
        sizes.append(len(list((tmp_path / "ckpt-allowed").iterdir())))
    assert sizes[1:] == [jobs.ALERT_STATES] * 4
    assert rows(spark.read.parquet(table).drop("batch_id")) == rows(alerts.alerts(live.filter("day(time) < 6"), 7200))


def test_alerts_get_the_places_that_events_lack(spark, tmp_path):
    data = [("a", "fire", dt.datetime(2024, 1, 1), 0.1, 0.1, "P", "Extreme", None, 200.0, None, "Given"), ("b", "fire", dt.datetime(2024, 1, 2), 60.0, 0.1, "P", "Extreme", None, 200.0, None, None)]
    df = spark.createDataFrame(data, schemas.HAZARD_EVENT)
    gaz = spark.createDataFrame([(1, 0.0, 0.0, "C", None, None, "X")], "place_id long, lat double, lon double, city string, town string, village string, country string")
    land(spark, df, tmp_path / "in", 1)
    stream = stream_of(spark, tmp_path / "in", df.schema)
    sinks.finish(jobs.start_alerts(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), gazetteer=gaz, trigger=NOW))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_id", "location") == [("a", "C, Given"), ("b", "Unknown, Unknown")]


def test_ordered_alerts_of_events_in_any_order(spark, live, tmp_path):
    """Two restarts; each file holds every third event of a stretch of 6 days in 3 parts that overlap in time by an hour."""
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    days = live.filter("day(time) < 5").withColumn("n", F.floor((F.unix_micros(F.col("time").cast("timestamp")) / 3_600_000_000 + F.abs(F.hash("id")) % 60 / 60.0))).persist()
    low, high = days.agg(F.min("n"), F.max("n")).first()
    bounds = [low + (high + 1 - low) * i // 3 for i in range(4)]
    state = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = days.filter(f"n >= {lo} AND n < {hi}").orderBy(F.hash("id")).drop("n")
        part.coalesce(1).write.mode("append").parquet(str(folder))
        query = ordered.start_ordered_alerts(stream_of(spark, folder, live.schema), table, checkpoint, 7200, trigger=NOW)
        sinks.finish(query)
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    last = days.agg(F.max("time")).first()[0] - dt.timedelta(hours=2)
    due = days.filter(F.date_trunc("second", "time") + F.make_dt_interval(secs=F.lit(1)) <= F.lit(last))
    want = alerts.alerts(due.drop("n"), 7200).withColumn("alert_time", F.col("alert_time").cast("timestamp"))
    assert rows(spark.read.parquet(table)) == rows(want) and want.count() > 10
    assert max(state) <= 7  # one value per alert key and none for its rows
    with pytest.raises(ValueError):
        ordered.ordered_alerts(stream_of(spark, folder, live.schema), -1)


def test_ordered_alerts_in_cells_and_conf_is_restored(spark, live, tmp_path):
    land(spark, live.filter("day(time) < 3"), tmp_path / "in", 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = ordered.start_ordered_alerts(stream_of(spark, tmp_path / "in", live.schema), str(tmp_path / "out"), str(tmp_path / "c"), mode="cells", trigger=NOW)
    sinks.finish(query)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before

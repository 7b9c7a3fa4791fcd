"""One query per operator, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import params, schemas
from hazardlens.functions import grading, places
from hazardlens.operators import alerts, cells, events, geo, history, listing, metrics
from hazardlens.plans import views
from hazardlens.sources import cell_table, feeds, ledger, place_index, ranked, text_index, topic
from hazardlens.sources.tables import shared_folder
from hazardlens.streaming import jobs, ordered, publish

ANOMALY_Z = {"magnitude": 3.0, "deaths": 2.0, "affected": 3.0}
GEOCODE_RADIUS_KM = 2000.0
QUERY_COOLDOWN = 3600


def decode_events(spark, sf):
    h = views.hazard(spark, sf)
    quake = topic.decode_messages(views.messages(h, "earthquake"), schemas.QUAKE_MESSAGE)
    fire = topic.decode_messages(views.messages(h, "fire"), schemas.FIRE_MESSAGE)
    shared = ["latitude", "longitude", "kafka_timestamp"]
    return quake.select(F.lit("earthquake").alias("kind"), "id", "time", F.col("magnitude").alias("value"), "place", *shared).unionByName(
        fire.select(F.lit("fire").alias("kind"), "id", "time", F.col("frp").alias("value"), F.lit(None).cast("string").alias("place"), *shared)
    )


def message_rejects(spark, sf):
    h = views.hazard(spark, sf)
    quake = topic.message_rejects(views.messages(h, "earthquake"), schemas.QUAKE_MESSAGE)
    fire = topic.message_rejects(views.messages(h, "fire"), schemas.FIRE_MESSAGE)
    return quake.unionByName(fire).select("timestamp", "reason")


def ingest_geojson(spark, sf):
    payloads = views.geojson_payloads(views.hazard(spark, sf))
    return feeds.quake_rows(feeds.decode_payload(payloads, schemas.GEOJSON))


def ingest_geojson_split(spark, sf):
    """The same rows from files of one large collection a day."""
    folder = shared_folder(spark, "collections")
    payloads = views.geojson_payloads(views.hazard(spark, sf), F.to_date("time").alias("day"))
    views.collection_files(payloads, "features", folder)
    return feeds.quake_rows(feeds.read_geojson_split(spark, folder))


def ingest_fire_csv(spark, sf):
    return feeds.fire_rows(views.fire_csv_rows(views.hazard(spark, sf)))


def rejects(spark, sf):
    return feeds.fire_rejects(views.fire_csv_rows(views.hazard(spark, sf))).select("id", "reason")


def ingest_eonet(spark, sf):
    payloads = views.natural_event_payloads(views.hazard(spark, sf))
    return feeds.natural_event_rows(feeds.decode_payload(payloads, schemas.NATURAL_EVENTS))


def new_events_only(spark, sf):
    incoming = ingest_eonet(spark, sf)
    loaded = views.hazard(spark, sf).filter(F.col("time") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return feeds.new_rows_only(incoming, loaded)


def high_water_mark(spark, sf):
    return feeds.high_water_mark(ingest_eonet(spark, sf))


class _Interrupted(Exception):
    pass


def incremental_load(spark, sf):
    """Three landings, three loads: the second is asked for twice, the third first ends before its ledger row."""
    folder = shared_folder(spark, "loads")
    arrivals = views.natural_event_arrivals(views.hazard(spark, sf))

    def decoded(landed: DataFrame) -> DataFrame:
        return feeds.natural_event_rows(feeds.decode_payload(landed, schemas.NATURAL_EVENTS))

    def interrupt() -> None:
        raise _Interrupted

    table = ledger.LoadTable(spark, folder, decoded(arrivals).schema)
    for name in views.ARRIVALS:
        arrivals.filter(F.col("arrived") == name).write.mode("append").partitionBy("arrived").parquet(f"{folder}/landed")
        landed = spark.read.schema("value string, arrived string").parquet(f"{folder}/landed")
        if name == "c":
            with suppress(_Interrupted):
                table.load(name, landed, decoded, interrupt)
        for _ in range(2 if name == "b" else 1):
            table.load(name, landed, decoded)
    rows = table.rows().select("id", "load_id", "last_modified", "event_name", "type", "location", "url")
    return rows.join(table.ledger().select("load_id", "mark", "row_count"), "load_id")


def _plain_events(spark, sf) -> DataFrame:
    return _plain(views.events(spark, sf))


def _plain(rows: DataFrame) -> DataFrame:
    """Events with numbers as fixed-point decimals, whose text is the same on every engine."""
    return rows.withColumns(
        {
            "latitude": F.col("latitude").cast("decimal(9,4)"),
            "longitude": F.col("longitude").cast("decimal(9,4)"),
            "magnitude": F.col("magnitude").cast("decimal(9,4)"),
            "frp": F.col("frp").cast("decimal(12,2)"),
        }
    )


def _epoch_ms(name: str) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(feeds.EPOCH), F.col(name))


def publish_json(spark, sf):
    shown = _plain_events(spark, sf).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return topic.to_messages(shown)


def event_cells(spark, sf):
    return cells.encode_cells(cells.event_cells(_plain_events(spark, sf), "id", _epoch_ms("time")))


def latest_cells(spark, sf):
    return cells.latest_cells(
        cells.event_cells(
            _plain_events(spark, sf), "country", _epoch_ms("time"),
            ["type", "time", "latitude", "longitude", "place", "severity", "magnitude", "frp", "city"],
        )
    )


def merge_cells(spark, sf):
    """Three merges of overlapping stretches of time, the second of them twice: the cells that are current in the end."""
    table = cell_table.CellTable(spark, shared_folder(spark, "cells"), slots=8, buckets=4)
    plain, names = _plain_events(spark, sf), ["type", "time", "latitude", "longitude", "place", "severity", "magnitude", "frp", "city"]
    for name, first, end in (("a", 1, 14), ("b", 10, 22), ("b", 10, 22), ("c", 20, 32)):
        own = plain.filter(F.dayofmonth("time").between(first, end))
        table.merge(name, cells.event_cells(own, "country", _epoch_ms("time"), names))
    return table.read()


def rowkey_struct(spark, sf):
    return cells.rowkey_struct(views.events(spark, sf)).select("rowkey", "data.*")


def fire_lookback(spark, sf):
    h = views.hazard(spark, sf)
    return events.fire_lookback(views.fires_of(h), views.newest(spark, sf))


def _live(spark, sf) -> DataFrame:
    return views.events(spark, sf, levels=3)


def time_range(spark, sf):
    e = _live(spark, sf)
    return events.time_range(e, views.newest(spark, sf), "12h")


def event_feed(spark, sf):
    e = _live(spark, sf)
    return events.event_feed(e, views.newest(spark, sf))


def page(spark, sf):
    return listing.page(_live(spark, sf), [F.desc("time"), F.col("id")], 2, 10)


def page_deep(spark, sf):
    """A page far into a stored order."""
    stored = ranked.RankedListing.build(_live(spark, sf), shared_folder(spark, "ranked"), (("time", True), ("id", False)), parts=32)
    return stored.page(60, 5)


def search_indexed(spark, sf):
    """The search of ``event_search`` in a stored index of its texts."""
    stored = text_index.TextIndex.build(_live(spark, sf), shared_folder(spark, "texts"), ("place", "type"), blocks=32)
    return stored.search("America")


def page_after(spark, sf):
    """The ten rows from the newest time on: those behind a row of that time with the smallest id there could be."""
    last = {"time": views.newest(spark, sf).scalar(), "id": F.lit("")}
    return listing.page_after(_live(spark, sf), [("time", True), ("id", False)], last, 10)


def _hazard_id(spark, sf, **columns: Column) -> DataFrame:
    return views.hazard(spark, sf).select("id", *[c.alias(n) for n, c in columns.items()])


def severity3(spark, sf):
    return _hazard_id(
        spark, sf,
        quake_severity=grading.grade(F.col("magnitude"), params.QUAKE_GRADES_3),
        fire_severity=grading.grade(F.col("frp"), params.FIRE_GRADES_3),
    )


def severity_quake4(spark, sf):
    m = F.col("magnitude")
    return _hazard_id(spark, sf, magnitude=m, severity=grading.grade(m, params.QUAKE_GRADES_4))


def severity_fire4(spark, sf):
    p = F.col("frp")
    return _hazard_id(spark, sf, frp=p, severity=grading.grade(p, params.FIRE_GRADES_4))


def region_of(spark, sf):
    region = places.region_of(F.col("latitude"), F.col("longitude"))
    return _hazard_id(spark, sf, region=region).withColumn("city", places.region_city(F.col("region")))


def place_parts(spark, sf):
    place = F.col("place")
    return _hazard_id(spark, sf, city=places.city_of(place), country=places.country_of(place))


def place_parts_legacy(spark, sf):
    place = F.col("place")
    return _hazard_id(spark, sf, city=places.comma_part(place, 0), country=places.comma_part(place, 1))


def kpi_cards(spark, sf):
    e = _live(spark, sf)
    return metrics.kpi_cards(e, views.newest(spark, sf))


def event_trend(spark, sf):
    e = _live(spark, sf)
    return metrics.event_trend(e, views.newest(spark, sf), "12h")


def reverse_geocode(spark, sf):
    return _geocoded(spark, sf, views.gazetteer(spark, sf))


def _geocoded(spark, sf, gazetteer) -> DataFrame:
    given = F.when(F.col("k") % 2 == 0, F.col("country"))
    h = views.hazard(spark, sf).select("id", "latitude", "longitude", given.alias("country"))
    out = geo.reverse_geocode(h, gazetteer, GEOCODE_RADIUS_KM)
    return out.select("id", "city", "country", "place_id", "distance_km")


def reverse_geocode_indexed(spark, sf):
    """The same places from a gazetteer index that is built once and opened again for the lookup."""
    folder = shared_folder(spark, "places")
    place_index.build(views.gazetteer(spark, sf), folder, GEOCODE_RADIUS_KM, buckets=16)
    return _geocoded(spark, sf, place_index.open_index(spark, folder))


def resolve_ids(spark, sf):
    e = _live(spark, sf)
    return geo.resolve_ids(e, geo.merge_colocated(e).select(F.col("id").alias("wanted_id")))


def alert_messages(spark, sf):
    return alerts.alert_messages(alerts.alerts(views.events(spark, sf)))


def correlations(spark, sf):
    return history.correlations(views.disasters(spark, sf))


def correlation_list(spark, sf):
    return listing.correlation_list(
        correlations(spark, sf), disaster_type="flood", days_between=2, query="_1", by="start_date_a", direction="desc"
    )


def anomalies(spark, sf):
    return history.anomalies(views.disasters(spark, sf), ANOMALY_Z)


def anomalies_incremental(spark, sf):
    """Limits merged from the moments of three loads, each scanned once when it came."""
    folder, rows = shared_folder(spark, "moments"), views.disasters(spark, sf)
    first, second = (F.lit(d).cast("date") for d in ("2024-01-11", "2024-01-21"))
    load = F.when(F.col("start_date") < first, 1).when(F.col("start_date") < second, 2).otherwise(3)
    for i in (3, 1, 2):
        history.moments(rows.filter(load == i)).write.parquet(f"{folder}/load={i}")
    merged = history.merge_moments(spark.read.parquet(folder))
    return history.anomalies(rows, ANOMALY_Z, history.statistics(merged))


def anomaly_list(spark, sf):
    return listing.anomaly_list(anomalies(spark, sf), anomaly_type="deaths", by="magnitude", direction="desc")


def hotspots(spark, sf):
    return history.hotspots(views.disasters(spark, sf))


def vulnerability(spark, sf):
    return history.vulnerability(views.disasters(spark, sf))


def _local_times(df: DataFrame) -> DataFrame:
    """Results carry zone-free UTC times, also where a stream needs the zoned type inside."""
    zoned = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns]) if zoned else df


Query = Callable[[SparkSession, str], DataFrame]


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _local_times(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    plain: dict[str, Query] = {
        "window_metrics": lambda s, d: metrics.window_metrics(views.events(s, d)),
        "quake_metrics": lambda s, d: metrics.metrics_of_type(views.events(s, d), "earthquake"),
        "fire_metrics": lambda s, d: metrics.metrics_of_type(views.events(s, d), "fire"),
        "kpi_cards": kpi_cards,
        "severity_distribution": lambda s, d: metrics.severity_distribution(_live(s, d)),
        "event_trend": event_trend,
        "event_bounds": lambda s, d: metrics.event_bounds(_live(s, d)),
        "decode_events": decode_events,
        "ingest_geojson": ingest_geojson,
        "ingest_geojson_split": ingest_geojson_split,
        "ingest_fire_csv": ingest_fire_csv,
        "ingest_eonet": ingest_eonet,
        "rejects": rejects,
        "message_rejects": message_rejects,
        "new_events_only": new_events_only,
        "high_water_mark": high_water_mark,
        "incremental_load": incremental_load,
        "publish_json": publish_json,
        "event_cells": event_cells,
        "latest_cells": latest_cells,
        "merge_cells": merge_cells,
        "rowkey_struct": rowkey_struct,
        "unified_events": lambda s, d: views.united_events(views.hazard(s, d)),
        "dedupe_events": lambda s, d: events.dedupe(views.republished(views.events(s, d))),
        "fire_lookback": fire_lookback,
        "time_range": time_range,
        "event_filter": lambda s, d: events.event_filter(_live(s, d), "fire", "high"),
        "event_search": lambda s, d: events.event_search(_live(s, d), "America"),
        "search_indexed": search_indexed,
        "event_feed": event_feed,
        "page": page,
        "page_after": page_after,
        "page_deep": page_deep,
        "severity_quake4": severity_quake4,
        "severity_fire4": severity_fire4,
        "severity3": severity3,
        "region_of": region_of,
        "place_parts": place_parts,
        "place_parts_legacy": place_parts_legacy,
        "reverse_geocode": reverse_geocode,
        "reverse_geocode_indexed": reverse_geocode_indexed,
        "merge_colocated": lambda s, d: geo.merge_colocated(_live(s, d)),
        "resolve_ids": resolve_ids,
        "mercator_grid": lambda s, d: geo.mercator_grid(_live(s, d)),
        "tile_pyramid": lambda s, d: geo.tile_pyramid(_live(s, d)),
        "alert_candidates": lambda s, d: alerts.alert_candidates(views.events(s, d)),
        "alerts_cooldown": lambda s, d: alerts.alerts(views.events(s, d), QUERY_COOLDOWN),
        "alert_messages": alert_messages,
        "correlations": correlations,
        "correlation_list": correlation_list,
        "correlation_choices": lambda s, d: listing.correlation_choices(history.correlated_days(views.disasters(s, d))),
        "anomalies": anomalies,
        "anomalies_incremental": anomalies_incremental,
        "anomaly_list": anomaly_list,
        "hotspots": hotspots,
        "hotspot_list": lambda s, d: listing.hotspot_list(hotspots(s, d), "flood"),
        "vulnerability": vulnerability,
        "vulnerability_summary": lambda s, d: history.vulnerability_summary(vulnerability(s, d)),
        "vulnerability_list": lambda s, d: listing.vulnerability_list(vulnerability(s, d), "Nation_1"),
        "stream_metrics": stream_metrics,
        "stream_dedupe": stream_dedupe,
        "stream_alerts": stream_alerts,
        "stream_alerts_ordered": stream_alerts_ordered,
        "stream_cells": stream_cells,
        "stream_publish": stream_publish,
    }
    return {name: _registered(query) for name, query in plain.items()}


def _arriving(spark, sf, mixed: bool = False):
    """Hazard rows of events that arrive in several stretches; the jobs start anew for each."""
    stream, arrivals = views.events_stream(spark, sf, mixed=mixed)
    return views.events_of(views.hazard_of(stream, views.table(spark, sf, "nation"))), arrivals


def stream_metrics(spark, sf):
    rows, arrivals = _arriving(spark, sf)
    return jobs.run_metrics(jobs.watermarked(rows), arrivals)


def stream_dedupe(spark, sf):
    rows, arrivals = _arriving(spark, sf)
    return jobs.run_dedupe(jobs.watermarked(views.resent(rows)), arrivals).select("id", "type", "time", "severity", "magnitude", "frp")


def stream_alerts(spark, sf):
    rows, arrivals = _arriving(spark, sf)
    return jobs.run_alerts(jobs.watermarked(rows), QUERY_COOLDOWN, arrivals)


def stream_alerts_ordered(spark, sf):
    """Events that arrive out of order within the watermark, the job starting anew for each arrival."""
    rows, arrivals = _arriving(spark, sf, mixed=True)
    return ordered.run_ordered_alerts(jobs.watermarked(rows), QUERY_COOLDOWN, arrivals)


def stream_cells(spark, sf):
    rows, arrivals = _arriving(spark, sf)
    return jobs.run_cells(jobs.watermarked(_plain(rows)), arrivals)


def stream_publish(spark, sf):
    """Polls of the earthquake feed that land in three arrivals, the job starting anew for each; every event is sent once."""
    folder, arrivals = views.payload_arrivals(spark, sf)
    events = publish.quake_events(publish.payload_stream(spark, folder, one_per_line=True))
    shown = events.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return publish.run_publish(shown, ("id", "time", "place", "url", "city", "country"), arrivals)

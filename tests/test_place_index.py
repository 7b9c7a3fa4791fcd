"""A stored gazetteer index against the gazetteer itself, in batch and in a stream."""

from __future__ import annotations

import pytest
from conftest import plan, rows

from hazardlens import schemas
from hazardlens.operators import geo
from hazardlens.plans import views
from hazardlens.sources import place_index
from hazardlens.streaming import jobs, sinks


@pytest.fixture(scope="module")
def gazetteer(spark, small):
    return views.gazetteer(spark, small)


def test_lookups_equal_those_of_the_gazetteer(spark, small, gazetteer, tmp_path):
    """With so few places to a part that cells with several places have several parts."""
    more = gazetteer.union(gazetteer.selectExpr("place_id + 1000", "lat", "lon", "city", "town", "village", "country")).union(
        spark.sql("SELECT 5000L, CAST(NULL AS DOUBLE), 1.0D, 'x', 'x', 'x', 'x'")
    )
    index = place_index.build(more, str(tmp_path / "i"), 2000.0, buckets=4, part_rows=1)
    h = views.hazard(spark, small).select("id", "latitude", "longitude", "country")
    want = geo.reverse_geocode(h, more, 2000.0)
    assert rows(geo.reverse_geocode(h, index, 2000.0)) == rows(want)
    again = place_index.open_index(spark, str(tmp_path / "i"))
    assert rows(geo.reverse_geocode(h, again)) == rows(want)
    points = h.selectExpr("CAST(floor(latitude * 100 + 0.5) AS BIGINT) AS lat_c", "CAST(floor(longitude * 100 + 0.5) AS BIGINT) AS lon_c").distinct()
    assert rows(index.nearest(points, 300.0)) == rows(geo.nearest_places(points, more, 300.0))


def test_the_places_are_not_shuffled(spark, gazetteer, tmp_path):
    index = place_index.build(gazetteer, str(tmp_path / "i"), 500.0, buckets=4)
    points = spark.range(100).selectExpr("id AS lat_c", "id * 3 AS lon_c")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(index.nearest(points))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = shown.index("p_lat")
    above = shown[: shown.index("FileScan parquet spark_catalog")].rsplit("SortMergeJoin", 1)[1]
    assert scan and "Bucketed: true" in shown and "Exchange" not in above.rsplit("+- Sort", 1)[1]


def test_stream_fills_places_from_the_index(spark, tmp_path):
    import datetime as dt

    data = [("a", "fire", dt.datetime(2024, 1, 1), 0.1, 0.1, "P", "Low", None, 1.0, None, "Given"), ("b", "fire", dt.datetime(2024, 1, 1), 60.0, 0.1, "P", "Low", None, 1.0, None, None)]
    spark.createDataFrame(data, schemas.HAZARD_EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    gaz = spark.createDataFrame([(1, 0.0, 0.0, "C", None, None, "X")], "place_id long, lat double, lon double, city string, town string, village string, country string")
    index = place_index.build(gaz, str(tmp_path / "i"))
    stream = jobs.watermarked(spark.readStream.schema(schemas.HAZARD_EVENT).parquet(str(tmp_path / "in")))
    sinks.finish(jobs.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "c"), gazetteer=index, trigger=jobs.DRAIN))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "city", "country") == [("a", "C", "Given"), ("b", "Unknown", "Unknown")]

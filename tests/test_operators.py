"""Operators on small hand-made tables: boundaries, ties, golden values, brute force."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from conftest import optimized, plan, rows
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions import numbers
from hazardlens.operators import alerts, cells, cooldown, events, geo, history, listing, metrics, skew
from hazardlens.plans import views

T0 = dt.datetime(2024, 1, 1, 12)


def hazard_events(spark, data):
    """(id, type, offset seconds, value, lat, lon, place) as unified events with 3 grades."""
    quakes = [(i, T0 + dt.timedelta(seconds=s), v, p, la, lo) for i, t, s, v, la, lo, p in data if t == "earthquake"]
    fires = [(i, T0 + dt.timedelta(seconds=s), v, p, la, lo) for i, t, s, v, la, lo, p in data if t == "fire"]
    q = spark.createDataFrame(quakes, "id string, time timestamp_ntz, magnitude double, place string, latitude double, longitude double")
    f = spark.createDataFrame(fires, "id string, time timestamp_ntz, frp double, place string, latitude double, longitude double")
    return events.unify(q, f, params.QUAKE_GRADES_3, params.FIRE_GRADES_3)


def test_unify_pads_and_grades(spark):
    e = hazard_events(spark, [("q", "earthquake", 0, 4.0, 1.0, 2.0, "P"), ("f", "fire", 0, None, 1.0, 2.0, "R")])
    assert rows(e, "id", "type", "severity", "magnitude", "frp", "city") == [
        ("f", "fire", "Unknown", None, None, None), ("q", "earthquake", "moderate", 4.0, None, None),
    ]


def test_metrics_keep_types_apart_and_windows_half_open(spark):
    e = hazard_events(
        spark,
        [("a", "earthquake", 0, 4.5, 0.0, 0.0, "P"), ("b", "earthquake", 59, 5.5, 0.0, 0.0, "P"), ("c", "earthquake", 60, 5.0, 0.0, 0.0, "P"),
         ("d", "fire", 0, 7.0, 0.0, 0.0, "R")],
    )
    got = rows(metrics.window_metrics(e), "window_start", "type", "severity", "event_count", "avg_value", "max_value")
    assert got == [
        (T0, "earthquake", "moderate", 2, 5.0, 5.5), (T0, "fire", "moderate", 1, 7.0, 7.0),
        (T0 + dt.timedelta(minutes=1), "earthquake", "moderate", 1, 5.0, 5.0),
    ]


def test_cards_without_events(spark):
    empty = hazard_events(spark, [])
    assert tuple(metrics.kpi_cards(empty, T0).first()) == (0, 0, 0, 0.0, 0.0, 0, 0)
    assert rows(metrics.severity_distribution(empty)) == [("high", 0, 0.0), ("low", 0, 0.0), ("moderate", 0, 0.0)]


def test_last_hour_is_strict_and_lookback_inclusive(spark):
    e = hazard_events(spark, [("a", "fire", -3600, 1.0, 0.0, 0.0, "R"), ("b", "fire", -3599, 1.0, 0.0, 0.0, "R"),
                              ("c", "fire", -(3 * 3600 + 60), 1.0, 0.0, 0.0, "R"), ("d", "fire", -(3 * 3600 + 61), 1.0, 0.0, 0.0, "R")])
    assert metrics.kpi_cards(e, T0).first()["recent_events"] == 1
    assert rows(events.fire_lookback(e, T0), "id") == [("a",), ("b",), ("c",)]
    assert rows(events.time_range(e, T0, "1h"), "id") == [("a",), ("b",)]
    assert events.time_range(e, T0, "week").count() == 4


@pytest.mark.parametrize("name", list(params.TIME_RANGES))
def test_trend_buckets_tile_the_range(spark, name):
    span = params.TIME_RANGES[name]
    width = span / 12
    offsets = [0, -width / 2, -width, -(span - width), -(span - width) - 0.5 * width, -span, 1]
    e = hazard_events(spark, [(str(i), "fire", s, 1.0, 0.0, 0.0, "R") for i, s in enumerate(offsets)])
    got = [r["event_count"] for r in metrics.event_trend(e, T0, name).orderBy("bucket").collect()]
    assert len(got) == 12 and sum(got) == 5
    assert got[11] == 2 and got[10] == 1


def test_search_and_filters(spark):
    e = hazard_events(spark, [("a", "fire", 0, 20.0, 0.0, 0.0, "Rio"), ("b", "earthquake", 0, 2.0, 0.0, 0.0, None)])
    assert rows(events.event_search(e, "RIO"), "id") == [("a",)]
    assert rows(events.event_search(e, "quake"), "id") == [("b",)]
    assert events.event_search(e, "").count() == 2
    assert rows(events.event_filter(e, "fire", "high"), "id") == [("a",)]
    assert events.event_filter(e).count() == 2


def test_dedupe_keeps_the_earliest(spark):
    e = hazard_events(spark, [("a", "fire", 5, 2.0, 0.0, 0.0, "late"), ("a", "fire", 0, 1.0, 0.0, 0.0, "early"), ("b", "fire", 0, None, 0.0, 0.0, "R")])
    assert rows(events.dedupe(e), "id", "place") == [("a", "early"), ("b", "R")]


# --- alerts ---------------------------------------------------------------------------------


def greedy(times, gap):
    out, allowed = [], -math.inf
    for t in sorted(set(times)):
        if t >= allowed:
            out.append(t)
            allowed = t + gap
    return out


def candidates(spark, data):
    """(key, epoch second, value, id)"""
    shaped = [(k, i, "fire", "Low", float(v), dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)) for k, s, v, i in data]
    return spark.createDataFrame(shaped, "alert_key string, event_id string, event_type string, severity string, value double, time timestamp_ntz")


def fired_seconds(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["alert_key"], []).append(int((r["second"] - dt.datetime(1970, 1, 1)).total_seconds()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("gap", [1, 60, 97, 1000])
def test_cooldown_equals_a_plain_loop(spark, gap):
    rng = random.Random(gap)
    data = {"dense": [1_700_000_000 + s for s in range(0, 4000, 1)], "sparse": [1_700_000_000 + rng.randrange(0, 200_000) for _ in range(300)],
            "mixed": [1_700_000_000 + int(rng.gauss(5000, 900)) for _ in range(1500)], "one": [1_700_000_007]}
    rows_in = [(k, s, 1.0, f"{k}{n}") for k, ss in data.items() for n, s in enumerate(ss)]
    got = fired_seconds(cooldown.apply(candidates(spark, rows_in), gap, block=500))
    assert got == {k: greedy(ss, gap) for k, ss in data.items()}


def test_cooldown_boundary_and_best_row(spark):
    data = [("k", 0, 5.0, "a"), ("k", 0, 9.0, "c"), ("k", 0, 9.0, "b"), ("k", 59, 9.0, "d"), ("k", 60, 1.0, "e"), ("k", 119, 1.0, "f")]
    out = cooldown.apply(candidates(spark, data), 60)
    assert sorted((r["event_id"]) for r in out.collect()) == ["b", "e"]


def test_alerts_skip_unknown_values(spark):
    e = hazard_events(spark, [("a", "fire", 0, None, 0.0, 0.0, "R"), ("b", "fire", 0, 1.0, 0.0, 0.0, "R")])
    e = events.graded(e)
    assert rows(alerts.alert_candidates(e), "event_id", "alert_key", "location") == [("b", "fire_Low", "Unknown, Unknown")]


# --- places ---------------------------------------------------------------------------------


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * params.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [30.0, 700.0, 4000.0, 20000.0])
def test_geocode_equals_brute_force(spark, radius):
    rng = random.Random(int(radius))
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)]
    spots += [(1000 + i, 45 + rng.uniform(-0.4, 0.4), 7 + rng.uniform(-0.4, 0.4)) for i in range(200)]
    spots += [(2000, 89.9, 10.0), (2001, -89.95, -170.0), (2002, 0.0, 180.0), (2003, 0.0, -179.9)]
    points = [(str(i), round(rng.uniform(-90, 90), 2), round(rng.uniform(-180, 180), 2)) for i in range(150)]
    points += [(f"c{i}", round(45 + rng.uniform(-1, 1), 2), round(7 + rng.uniform(-1, 1), 2)) for i in range(100)]
    points += [("n", 89.99, -170.0), ("s", -90.0, 0.0), ("d", 0.01, -180.0), ("e", 0.0, 179.99), ("none", None, None)]
    gaz = spark.createDataFrame(
        [(i, la, lo, None, f"t{i}" if i % 2 else None, None, "X") for i, la, lo in spots],
        "place_id long, lat double, lon double, city string, town string, village string, country string",
    )
    ev = spark.createDataFrame(points, "id string, latitude double, longitude double")
    got = {r["id"]: (r["place_id"], r["city"], r["country"]) for r in geo.reverse_geocode(ev, gaz, radius).collect()}
    assert len(got) == len(points)
    for i, la, lo in points:
        best = min(((round(km((la, lo), (pa, po)), 6), p) for p, pa, po in spots), default=None) if la is not None else None
        if best is None or best[0] > radius:
            assert got[i] == (None, "Unknown", "Unknown")
        else:
            assert got[i] == (best[1], f"t{best[1]}" if best[1] % 2 else "Unknown", "X")


def test_geocode_meets_few_places_however_many_share_a_cell(spark):
    rnd = random.Random(5)
    spots = [(i, round(45 + rnd.uniform(0, 2), 3), round(7 + rnd.uniform(0, 2), 3)) for i in range(3000)] + [(9000 + i, 45.5, 7.5) for i in range(500)]
    points = [(round(100 * (45 + rnd.uniform(-0.5, 2.5))), round(100 * (7 + rnd.uniform(-0.5, 2.5)))) for _ in range(200)]
    names = "place_id long, lat double, lon double, city string, town string, village string, country string"
    gaz = spark.createDataFrame([(*s, "C", None, None, "X") for s in spots], names)
    pts = spark.createDataFrame(points, "lat_c long, lon_c long").distinct()
    distinct = geo.distinct_places(gaz)
    grid = geo.grid_for(distinct, 2000.0)
    placed = geo.placed_cells(distinct, grid)
    cells = geo.cells_with_parts(placed)
    met = geo.wanted_parts(geo.point_cells(pts, grid), cells, grid).join(geo.packed_places(placed, cells), ["py", "px", "part"])
    most = met.groupBy("lat_c", "lon_c").agg(F.sum(F.size("places")).alias("n")).agg(F.max("n")).first()[0]
    assert grid.depth > 0 and most <= 400
    got = {(r["lat_c"], r["lon_c"]): r["near"]["place_id"] for r in geo.nearest_places(pts, gaz, 2000.0).collect()}
    assert got == {(la, lo): min((round(km((la / 100, lo / 100), (pa, po)), 6), i) for i, pa, po in spots)[1] for la, lo in set(points)}


def test_geocode_keeps_given_names(spark):
    gaz = spark.createDataFrame([(1, 0.0, 0.0, "C", None, None, "X")], "place_id long, lat double, lon double, city string, town string, village string, country string")
    ev = spark.createDataFrame([("a", 0.1, 0.1, "Mine", None)], "id string, latitude double, longitude double, city string, country string")
    assert rows(geo.reverse_geocode(ev, gaz, 50.0), "city", "country") == [("Mine", "X")]
    assert rows(geo.reverse_geocode(ev, gaz, 50.0, keep_given=False), "city", "country") == [("C", "X")]


def test_merge_and_resolve(spark):
    e = hazard_events(
        spark,
        [("a", "earthquake", 0, 5.0, 1.0, 2.0, "P"), ("b", "earthquake", 9, 6.5, 1.0, 2.0, "Q"), ("c", "fire", 1, 3.0, 1.0, 2.0, "R"),
         ("d", "fire", 2, None, 7.0, 8.0, "S"), ("e", "fire", 3, 1.0, 9.0, 9.0, "U"), ("f", "fire", 4, 1.0, 9.0, 9.0, "V")],
    )
    merged = geo.merge_colocated(e)
    assert rows(merged, "id", "place", "severity", "magnitude", "frp", "merged_count") == [
        ("d", "S", "Unknown", None, None, 1),
        ("merged_earthquake_1.000000_2.000000_2", "Q (2 earthquakes)", "high", 6.5, None, 2),
        ("merged_fire_1.000000_2.000000_1", "R", "low", None, 3.0, 1),
        ("merged_fire_9.000000_9.000000_2", "V (2 fires)", "low", None, 1.0, 2),
    ]
    ids = spark.createDataFrame([(i,) for i in ["a", "merged_earthquake_1.000000_2.000000_2", "merged_fire_9.000000_9.000000_2", "nope"]], "wanted_id string")
    assert rows(geo.resolve_ids(e, ids), "wanted_id", "id") == [
        ("a", "a"), ("merged_earthquake_1.000000_2.000000_2", "b"), ("merged_fire_9.000000_9.000000_2", "f"),
    ]


def test_mercator_grid_counts_everything(spark):
    e = hazard_events(spark, [("a", "fire", 0, 20.0, 0.0, 0.0, "R"), ("b", "fire", 0, 1.0, 0.1, 0.1, "R"), ("c", "fire", 0, 6.0, 50.0, 100.0, "R")])
    got = rows(geo.mercator_grid(e), "cell_x", "cell_y", "event_count", "max_severity")
    assert (390, 300, 2, "high") in got and sum(r[2] for r in got) == 3


# --- history --------------------------------------------------------------------------------

# Golden values: (country, type, start, name) of both halves and the days between.
PAIRS = [
    ("Indonesia", "Earthquake", "2024-01-15", "Tsunami", "2024-01-16", 1), ("Philippines", "Typhoon", "2024-01-20", "Flood", "2024-01-22", 2),
    ("Australia", "Wildfire", "2024-01-10", "Drought", "2024-01-15", 5), ("Japan", "Earthquake", "2024-01-05", "Volcanic Activity", "2024-01-08", 3),
    ("United States", "Hurricane", "2024-01-18", "Flood", "2024-01-20", 2), ("Italy", "Earthquake", "2024-01-12", "Landslide", "2024-01-14", 2),
    ("Brazil", "Flood", "2024-01-01", "Landslide", "2024-01-05", 4), ("India", "Cyclone", "2024-01-25", "Flood", "2024-01-27", 2),
]


def disasters(spark, data):
    """(country, type, start date, name)"""
    return spark.createDataFrame(
        [(c, t, dt.date.fromisoformat(s), n) for c, t, s, n in data], "country string, disaster_type string, start_date date, event_name string"
    )


def test_correlations_golden(spark):
    data = [(c, a, s, a) for c, a, s, _, _, _ in PAIRS] + [(c, b, e, b) for c, _, _, b, e, _ in PAIRS]
    got = rows(history.correlations(disasters(spark, data)), "country", "disaster_type_a", "disaster_type_b", "days_between")
    assert got == sorted((c, a, b, d) for c, a, _, b, _, d in PAIRS)


def test_correlation_boundaries(spark):
    data = [("X", "Flood", "2024-01-01", "f"), ("X", "Storm", "2024-01-08", "in"), ("X", "Storm", "2024-01-09", "out"), ("X", "Storm", "2024-01-01", "same day"),
            ("X", "Flood", "2024-01-02", "same type"), ("Y", "Storm", "2024-01-01", "other country"), ("X", "Flood", "2024-01-01", "f")]
    got = {(r["event_name_a"], r["event_name_b"]): (r["days_between"], r["records_a"]) for r in history.correlations(disasters(spark, data)).collect()}
    assert got == {("f", "in"): (7, 2), ("f", "same day"): (0, 2), ("same type", "in"): (6, 1), ("same type", "out"): (7, 1), ("same day", "same type"): (1, 1)}


def test_correlations_equal_brute_force_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(history, "hot_keys", lambda counted, keys: skew.hot_keys(counted, keys, tasks=1, partitions=20))
    rng = random.Random(7)
    data = []
    for n in range(400):
        hot = rng.random() < 0.4
        day = dt.date(2023, 12, 28) if hot else dt.date(2023, 12, 1) + dt.timedelta(days=rng.randrange(60))
        data.append(("H" if hot else rng.choice("ABC"), rng.choice(["Flood", "Storm", "Fire"]), day.isoformat(), f"n{n}"))
    expected = set()
    for (ca, ta, sa, na), (cb, tb, sb, nb) in itertools.permutations(data, 2):
        gap = (dt.date.fromisoformat(sb) - dt.date.fromisoformat(sa)).days
        if ca == cb and ta != tb and 0 <= gap <= 7 and (gap > 0 or ta < tb):
            expected.add((na, nb))
    got = history.correlations(disasters(spark, data)).select("event_name_a", "event_name_b").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


# Golden values: (type, [(country, region, occurrences, impact)]) in rank order.
HOTSPOTS = {
    "earthquake": [("Japan", "Tohoku", 12, 3200), ("Indonesia", "Sumatra", 10, 2900), ("Chile", "Valparaiso", 8, 2100), ("Turkey", "Eastern Anatolia", 7, 1800), ("United States", "California", 6, 1500)],
    "wildfire": [("Australia", "New South Wales", 15, 4100), ("United States", "California", 13, 3900), ("Brazil", "Amazonas", 9, 2500), ("Canada", "British Columbia", 7, 1800), ("Portugal", "Leiria", 6, 1200)],
    "flood": [("Bangladesh", "Dhaka", 14, 5200), ("India", "Assam", 12, 4800), ("China", "Sichuan", 10, 3500), ("United States", "Louisiana", 8, 2100), ("Nigeria", "Lagos", 7, 1700)],
    "storm": [("Philippines", "Luzon", 16, 4300), ("United States", "Florida", 13, 3900), ("Mexico", "Yucatan", 9, 2500), ("Vietnam", "Central Coast", 8, 2100), ("Japan", "Okinawa", 7, 1700)],
    "volcanic_activity": [("Indonesia", "Java", 11, 3100), ("Iceland", "Reykjanes", 8, 2500), ("Italy", "Sicily", 7, 2200), ("Japan", "Kyushu", 6, 1800), ("Ecuador", "Galapagos", 5, 1200)],
}


def test_hotspots_golden(spark):
    data = []
    for kind, spots in HOTSPOTS.items():
        for country, region, n, impact in [*spots, ("Z", "minor", 1, 9000)]:
            data += [(kind, country, region, impact if i == 0 else 0, 0.0) for i in range(n)]
    df = spark.createDataFrame(data, "disaster_type string, country string, region string, deaths long, damage_kusd double")
    ranked = history.hotspots(df)
    for kind, spots in HOTSPOTS.items():
        got = [tuple(r) for r in listing.hotspot_list(ranked, kind).select("country", "region", "num_occurrences", "total_impact_score", "rank").collect()]
        assert got == [(c, r, n, float(i), k) for k, (c, r, n, i) in enumerate(spots, 1)]
    assert "WindowGroupLimit" in plan(ranked)


def test_vulnerability(spark):
    day = dt.date(2024, 1, 1)
    data = [("A", 10, 5.0, day, day + dt.timedelta(days=4)), ("A", 30, 15.0, day, day + dt.timedelta(days=6)), ("B", 0, 0.0, day, day), ("C", 40, 0.0, day, None)]
    df = spark.createDataFrame(data, "country string, deaths long, damage_kusd double, start_date date, end_date date")
    got = rows(history.vulnerability(df), "country", "disaster_count", "total_deaths", "total_damage", "avg_recovery_days", "vulnerability_index", "vulnerability_label")
    assert got == [("A", 2, 40, 20.0, 5.0, 1.0, "Critical"), ("B", 1, 0, 0.0, 0.0, 0.0, "Low"), ("C", 1, 40, 0.0, None, 1 / 3, "Low")]
    flat = history.vulnerability(df.filter("country = 'B'")).first()
    assert flat["vulnerability_index"] == 0.0


def test_vulnerability_summary_golden(spark):
    index = [("Haiti", 0.92), ("Philippines", 0.88), ("Indonesia", 0.85), ("Bangladesh", 0.82), ("Vietnam", 0.78)]
    df = spark.createDataFrame(index, "country string, vulnerability_index double")
    assert tuple(history.vulnerability_summary(df).first()) == (5, 0.85, 4)
    assert [r[0] for r in listing.vulnerability_list(df, "IN").select("country").collect()] == ["Philippines", "Indonesia"]


# Golden values: (id, type, start, magnitude, deaths, affected, label).
ANOMALIES = [
    ("1", "Earthquake", "2024-01-15", 8.7, 1200, 50000, "magnitude"), ("2", "Storm", "2024-01-20", None, 2500, 150000, "deaths"),
    ("3", "Wildfire", "2024-01-10", None, 150, 200000, "affected"), ("4", "Landslide", "2024-01-05", None, 800, 10000, "deaths"),
    ("5", "Flood", "2024-01-18", None, 300, 300000, "affected"), ("6", "Tsunami", "2024-01-12", 7.8, 500, 75000, "magnitude"),
    ("7", "Drought", "2024-01-01", None, 50, 1000000, "affected"), ("8", "Volcanic Activity", "2024-01-25", 6.2, 0, 25000, "magnitude"),
]


def test_anomaly_list_golden(spark):
    df = spark.createDataFrame(
        [(i, t, dt.date.fromisoformat(s), m, d, a, label) for i, t, s, m, d, a, label in ANOMALIES],
        "id string, disaster_type string, start_date date, magnitude double, deaths long, affected long, anomaly_type string",
    )
    up = [r["magnitude"] for r in listing.anomaly_list(df, by="magnitude").collect()]
    down = [r["magnitude"] for r in listing.anomaly_list(df, by="magnitude", direction="desc").collect()]
    assert up == [6.2, 7.8, 8.7, None, None, None, None, None] and down == [8.7, 7.8, 6.2, None, None, None, None, None]
    counts = {k: listing.anomaly_list(df, anomaly_type=k).count() for k in ("magnitude", "deaths", "affected")}
    assert counts == {"magnitude": 3, "deaths": 2, "affected": 3}
    assert rows(listing.anomaly_list(df, "VOLCANIC activity"), "id", "magnitude_text", "deaths_text") == [("8", "6.20", "0")]
    assert listing.anomaly_list(df, years=(2000, 2023)).count() == 0


def test_anomalies_label_and_nulls(spark):
    data = [(str(n), "Flood", None, 10, 100 + n % 3) for n in range(60)] + [("x", "Flood", None, 500, 102), ("y", "Flood", None, 10, 9000), ("solo", "Storm", 5.0, 1, 1)]
    df = spark.createDataFrame(data, "id string, disaster_type string, magnitude double, deaths long, affected long")
    assert rows(history.anomalies(df), "id", "anomaly_type") == [("x", "deaths"), ("y", "affected")]


def test_correlation_choices_and_page(spark):
    data = [("X", "Flood", "2024-01-01", "f"), ("X", "Storm", "2024-01-02", "s"), ("X", "Fire", "2024-01-03", "w")]
    pairs = history.correlations(disasters(spark, data))
    assert rows(listing.correlation_choices(pairs)) == [("country", "X"), ("disaster_type", "Fire"), ("disaster_type", "Flood"), ("disaster_type", "Storm")]
    listed = listing.correlation_list(pairs, disaster_type="Fire", days_between=1)
    assert rows(listed, "event_name_a", "event_name_b", "days_text") == [("s", "w", "1 day")]
    last = listing.page(pairs, listing.sort_order(pairs, "event_name_b", ties=("event_name_a",)), 2, 2).collect()
    assert [(r["event_name_a"], r["event_name_b"], r["from_row"], r["to_row"], r["total_results"]) for r in last] == [("s", "w", 3, 3, 3)]


# --- cells and skew -------------------------------------------------------------------------


def test_cells_drop_nulls_and_replay_changes_nothing(spark):
    e = spark.createDataFrame([("r", 1.5, None, 1), ("r", 2.5, "x", 2)], "id string, magnitude double, city string, at long")
    c = cells.event_cells(e, "id", F.col("at"), ["magnitude", "city"])
    latest = rows(cells.latest_cells(c), "qualifier", "ts", "value")
    assert latest == [("city", 2, "x"), ("magnitude", 2, "2.5")]
    assert rows(cells.latest_cells(c.union(c)), "qualifier", "ts", "value") == latest
    assert rows(cells.encode_cells(c.limit(1)), "key", "column") == [("cg==", "aW5mbzptYWduaXR1ZGU=")]
    keyed = cells.rowkey_struct(e).first()
    assert keyed["rowkey"] == "r" and keyed["data"]["cf"] == "info" and keyed["data"]["id"] == "r"


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id") % 50)
    left = spark.range(3000).select(key.alias("k"), "id")
    right = spark.createDataFrame([(-1, "hot")] + [(k, f"v{k}") for k in range(0, 40)], "k long, v string")
    hot = skew.hot_keys(left.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("rows")), ["k"], tasks=1, partitions=10)
    assert rows(hot) == [(-1, 5)]
    salted = skew.salted_join(left, right, ["k"], hot, how)
    assert rows(salted, "k", "id", "v") == rows(left.join(right, "k", how), "k", "id", "v")


def test_sums_and_averages_with_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    sums = lambda *v: tuple(spark.createDataFrame([(x,) for x in v], "v double").agg(numbers.exact_sum(F.col("v")), numbers.exact_avg(F.col("v"))).first())
    assert sums(1.0, nan, 3.0) == sums(1.0, 3.0, inf, -inf, None) == (4.0, 2.0)
    assert sums(1e25, 3.0) == (1e25 + 3, (1e25 + 3) / 2)
    assert sums(0.1234567, 0.0000001) == (0.1234568, 0.0617284)
    assert sums(nan, None) == sums(None) == (None, None)


def test_unknown_levels_are_counted(spark):
    e = spark.createDataFrame([("High",), ("low",), ("Extreme",), (None,)], "severity string")
    assert rows(metrics.severity_distribution(e)) == [("high", 1, 25.0), ("low", 1, 25.0), ("moderate", 0, 0.0), ("other", 2, 50.0)]


def test_later_years_stay_in_the_anomaly_list(spark):
    df = spark.createDataFrame([("a", "Flood", "deaths", dt.datetime(2031, 1, 1), 1.0, 1, 1)], "id string, disaster_type string, anomaly_type string, start_date timestamp_ntz, magnitude double, deaths long, affected long")
    assert listing.anomaly_list(df).count() == 1


def test_merged_ids_of_types_with_underscores(spark):
    e = spark.createDataFrame([("a", "volcanic_activity", dt.datetime(2024, 1, 1), 1.5, 2.5)], "id string, type string, time timestamp_ntz, latitude double, longitude double")
    ids = spark.createDataFrame([("merged_volcanic_activity_1.500000_2.500000_1",), ("merged_x",)], "wanted_id string")
    assert rows(geo.resolve_ids(e, ids), "wanted_id", "id") == [("merged_volcanic_activity_1.500000_2.500000_1", "a")]


# --- plans ----------------------------------------------------------------------------------


def test_metric_plans_stay_in_the_jvm_and_prune(spark, small):
    p = plan(metrics.window_metrics(views.events(spark, small)))
    assert "Python" not in p and "ArrowEval" not in p
    assert p.count("events.parquet") == 1 and "In(event_type, [click,error])" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_correlation_join_is_an_equi_join_on_country_and_bucket(spark, small):
    p = plan(history.correlations(views.disasters(spark, small)))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "bucket" in p


@pytest.mark.parametrize("name", ["reverse_geocode", "correlations", "anomalies", "alert_candidates", "vulnerability", "resolve_ids"])
def test_no_cross_joins(spark, small, name):
    from hazardlens.plans.queries import queries

    p = plan(queries()[name](spark, small))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_time_range_reaches_the_scan(spark, small):
    """A fixed "now" is pushed as a literal; "now" from the table is compared as a bare subquery."""
    e = views.events(spark, small, levels=3)
    fixed = plan(events.time_range(e, dt.datetime(2024, 1, 30), "12h"))
    assert "GreaterThanOrEqual(ts,2024-01-29T12:00)" in fixed
    moving = events.time_range(e, events.latest_time(e), "12h")
    assert "- INTERVAL" not in plan(moving).split("DataFilters")[1].split("Format")[0]


def test_pages_by_key_equal_pages_by_number(spark):
    data = [(f"i{n:02d}", dt.datetime(2024, 1, 1 + n % 4) if n % 7 else None) for n in range(30)]
    df = spark.createDataFrame(data, "id string, time timestamp_ntz")
    by = [("time", True), ("id", False)]
    ordered = [tuple(r) for r in df.orderBy(F.desc_nulls_last("time"), "id").collect()]
    for at in (0, 9, 20):
        last = {"time": F.lit(ordered[at][1]).cast("timestamp_ntz"), "id": F.lit(ordered[at][0])}
        assert [tuple(r) for r in listing.page_after(df, by, last, 5).collect()] == ordered[at + 1 : at + 6]


def test_cards_read_the_event_table_narrowly_for_now(spark, small):
    from hazardlens.plans.queries import queries

    p = queries()["kpi_cards"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p


def test_moments_merge_in_any_order(spark, small):
    import itertools

    from hazardlens.plans import views

    d = views.disasters(spark, small).select("disaster_type", "magnitude", "deaths", "affected").persist()
    parts = [history.moments(d.filter(F.col("deaths") % 5 == i)).persist() for i in range(3)] + [history.moments(d.filter(F.col("deaths") % 5 > 2)).persist()]
    whole = {(r[0], r[1]): r[2:] for r in history.moments(d).collect()}
    for order in list(itertools.permutations(range(4)))[::9]:
        a, b, c, e = (parts[i] for i in order)
        merged = history.merge_moments(history.merge_moments(a.union(b)).union(c).union(e))
        got = {(r[0], r[1]): r[2:] for r in merged.collect()}
        assert got.keys() == whole.keys()
        for k, (n, mean, m2) in got.items():
            assert n == whole[k][0] and mean == pytest.approx(whole[k][1], rel=1e-12) and m2 == pytest.approx(whole[k][2], rel=1e-9, abs=1e-9)
    limits = {r[0]: r[1:] for r in history.statistics(history.merge_moments(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))).collect()}
    for kind, avg, std in d.groupBy("disaster_type").agg(F.avg("deaths"), F.stddev_samp("deaths")).collect():
        assert limits[kind][1] == pytest.approx(avg, rel=1e-9) and limits[kind][4] == pytest.approx(std, rel=1e-9)


def test_z_order_there_and_back(spark):
    from hazardlens.functions import geometry

    pairs = spark.range(64).selectExpr("CAST(id div 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x").withColumn("z", geometry.z_order(F.col("y"), F.col("x"), 3))
    y, x = geometry.from_z_order(F.col("z"), 3)
    got = pairs.select("y", "x", "z", y.alias("y2"), x.alias("x2")).collect()
    assert sorted(r["z"] for r in got) == list(range(64)) and all((r["y"], r["x"]) == (r["y2"], r["x2"]) for r in got)
    assert {(r["y"], r["x"]): r["z"] for r in got}[2, 3] == 0b1101


def test_tile_pyramid_edges(spark):
    from hazardlens.operators import geo

    points = [(90.0, -180.0, "low"), (-90.0, 180.0, "high"), (0.0, 0.0, None), (None, 1.0, "low"), (85.06, 179.99, "moderate")]
    out = geo.tile_pyramid(spark.createDataFrame(points, "latitude double, longitude double, severity string"), zoom=2)
    got = {tuple(r)[:3]: (r["event_count"], r["max_severity"]) for r in out.collect()}
    assert got[0, 0, 0] == (4, "high")
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 0, 0): (1, "low"), (2, 3, 3): (1, "high"), (2, 2, 2): (1, "Unknown"), (2, 3, 0): (1, "moderate")}
    assert len([k for k in got if k[0] == 1]) == 3
    only = geo.tile_pyramid(spark.createDataFrame(points, "latitude double, longitude double, severity string"), zoom=0)
    assert [tuple(r) for r in only.collect()] == [(0, 0, 0, 4, "high")]

"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

import re

VIEWS = {
    "hazard": """
SELECT CAST(e.event_id AS VARCHAR) AS id, e.ts AS time,
  CASE e.event_type WHEN 'error' THEN 'earthquake' WHEN 'click' THEN 'wildfire' WHEN 'view' THEN 'flood'
                    WHEN 'signup' THEN 'storm' ELSE 'volcanic_activity' END AS disaster_type,
  CASE e.event_type WHEN 'error' THEN 'earthquake' WHEN 'click' THEN 'fire' END AS type,
  CASE WHEN e.event_type = 'error' THEN least(e.value / CAST(20 AS DOUBLE), CAST(9.5 AS DOUBLE)) END AS magnitude,
  CASE WHEN e.event_type = 'click' THEN e.value END AS frp,
  CAST((e.user_id * 37) % 1701 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(85 AS DOUBLE) AS latitude,
  CAST((e.k * 73 + e.user_id * 11) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
  concat(CAST(e.k AS VARCHAR), 'km NE of City', CAST(e.user_id AS VARCHAR), ', ', n.n_name) AS place,
  n.n_name AS country,
  concat(n.n_name, '_S', CAST(CAST((e.user_id - e.user_id % 25) / 25 AS BIGINT) % 4 AS VARCHAR)) AS region,
  e.k * e.k AS deaths,
  CAST(floor(e.value * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS damage_kusd,
  CAST(e.k % 60 AS INTEGER) AS recovery_days, e.k AS k
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e
JOIN nation n ON n.n_nationkey = e.user_id % 25""",
    "regions": """
SELECT *, CASE
  WHEN latitude BETWEEN 25 AND 70 AND longitude BETWEEN -130 AND -60 THEN 'North America'
  WHEN latitude BETWEEN 25 AND 70 AND longitude BETWEEN -170 AND -130 THEN 'Alaska/Western Canada'
  WHEN latitude BETWEEN -60 AND 15 AND longitude BETWEEN -85 AND -30 THEN 'South America'
  WHEN latitude BETWEEN 35 AND 75 AND longitude BETWEEN -15 AND 50 THEN 'Europe'
  WHEN latitude BETWEEN -10 AND 80 AND longitude BETWEEN 50 AND 180 THEN CASE
    WHEN latitude >= 50 AND longitude >= 80 THEN 'Siberia'
    WHEN latitude >= 20 AND longitude BETWEEN 100 AND 140 THEN 'East Asia'
    WHEN latitude >= 0 AND longitude BETWEEN 90 AND 150 THEN 'Southeast Asia'
    ELSE 'Asia' END
  WHEN latitude BETWEEN -40 AND 40 AND longitude BETWEEN -20 AND 55 THEN 'Africa'
  WHEN latitude BETWEEN -50 AND -5 AND longitude BETWEEN 110 AND 180 THEN 'Australia/Oceania'
  ELSE printf('%.1f°, %.1f°', latitude, longitude) END AS earth_region
FROM hazard""",
    "quakes": """
SELECT id, time, magnitude, place, latitude, longitude, k,
  trim(split_part(split_part(place, ' of ', 2), ',', 1)) AS city, trim(split_part(place, ',', -1)) AS country
FROM hazard WHERE type = 'earthquake'""",
    "fires": """
SELECT id, time, frp, latitude, longitude, earth_region AS place, k,
  split_part(earth_region, '/', 1) AS city, earth_region AS country
FROM regions WHERE type = 'fire'""",
    "both_kinds": """
SELECT id, 'earthquake' AS type, time, latitude, longitude, place, magnitude, CAST(NULL AS DOUBLE) AS frp, city, country FROM quakes
UNION ALL
SELECT id, 'fire', time, latitude, longitude, place, NULL, frp, city, country FROM fires""",
    "events4": """
SELECT id, type, time, latitude, longitude, place, CASE
  WHEN type = 'earthquake' THEN CASE WHEN magnitude < 4 THEN 'Low' WHEN magnitude < 6 THEN 'Moderate' WHEN magnitude < 7 THEN 'High' ELSE 'Extreme' END
  ELSE CASE WHEN frp < 5 THEN 'Low' WHEN frp < 15 THEN 'Moderate' WHEN frp < 50 THEN 'High' ELSE 'Extreme' END END AS severity,
  magnitude, frp, city, country
FROM both_kinds""",
    "events3": """
SELECT id, type, time, latitude, longitude, place, CASE
  WHEN type = 'earthquake' THEN CASE WHEN magnitude < 4 THEN 'low' WHEN magnitude < 6 THEN 'moderate' ELSE 'high' END
  ELSE CASE WHEN frp < 5 THEN 'low' WHEN frp < 15 THEN 'moderate' ELSE 'high' END END AS severity,
  magnitude, frp, city, country
FROM both_kinds""",
    "disasters": """
SELECT id, concat(disaster_type, ' ', region) AS event_name, disaster_type, country, region,
  CAST(time AS DATE) AS start_date, CAST(time AS DATE) + recovery_days AS end_date,
  CAST(time AS DATE) + recovery_days AS last_updated, magnitude, deaths, damage_kusd AS affected,
  CAST(damage_kusd AS DOUBLE) AS damage_kusd, concat('https://example.com/disaster/', id) AS source,
  latitude AS lat, longitude AS lon
FROM hazard""",
    "gazetteer": """
SELECT s.s_suppkey AS place_id,
  CAST((s.s_suppkey * 131) % 1401 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(70 AS DOUBLE) AS lat,
  CAST((s.s_suppkey * 977) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
  CASE WHEN s.s_suppkey % 4 <> 3 THEN s.s_name ELSE 'Unknown' END AS city, n.n_name AS country
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "candidates": """
SELECT concat(type, '_', severity) AS alert_key, id AS event_id, type AS event_type, severity,
  coalesce(magnitude, frp) AS value, alert_limit, concat(city, ', ', country) AS location, time
FROM (SELECT *, CASE
    WHEN type = 'earthquake' THEN CASE severity WHEN 'Low' THEN 2.0 WHEN 'Moderate' THEN 4.0 WHEN 'High' THEN 6.0 WHEN 'Extreme' THEN 7.0 END
    ELSE CASE severity WHEN 'Low' THEN 1.0 WHEN 'Moderate' THEN 5.0 WHEN 'High' THEN 50.0 WHEN 'Extreme' THEN 100.0 END
  END::DOUBLE AS alert_limit FROM events4)
WHERE coalesce(magnitude, frp) >= alert_limit""",
    "combined": """
SELECT * FROM (SELECT *, date_trunc('second', time) AS second,
  row_number() OVER (PARTITION BY alert_key, date_trunc('second', time) ORDER BY value DESC, event_id) AS pick FROM candidates)
WHERE pick = 1""",
    "pairs": """
SELECT a.country, a.disaster_type AS disaster_type_a, a.start_date AS start_date_a, a.event_name AS event_name_a, a.records AS records_a,
  b.disaster_type AS disaster_type_b, b.start_date AS start_date_b, b.event_name AS event_name_b, b.records AS records_b,
  CAST(b.start_date - a.start_date AS INTEGER) AS days_between
FROM (SELECT country, disaster_type, start_date, event_name, count(*) AS records FROM disasters GROUP BY ALL) a
JOIN (SELECT country, disaster_type, start_date, event_name, count(*) AS records FROM disasters GROUP BY ALL) b
  ON a.country = b.country AND a.disaster_type <> b.disaster_type AND b.start_date BETWEEN a.start_date AND a.start_date + 7
 AND (a.start_date < b.start_date OR a.disaster_type < b.disaster_type)""",
    "odd_disasters": """
SELECT d.*, CASE greatest(m_score, d_score, a_score) WHEN m_score THEN 'magnitude' WHEN d_score THEN 'deaths' ELSE 'affected' END AS anomaly_type
FROM (SELECT d.*,
    CASE WHEN magnitude > m_avg + 3 * m_std THEN (magnitude - m_avg) / m_std END AS m_score,
    CASE WHEN deaths > d_avg + 2 * d_std THEN (deaths - d_avg) / d_std END AS d_score,
    CASE WHEN affected > a_avg + 3 * a_std THEN (affected - a_avg) / a_std END AS a_score
  FROM disasters d JOIN (SELECT disaster_type, avg(magnitude) AS m_avg, stddev_samp(magnitude) AS m_std, avg(deaths) AS d_avg,
      stddev_samp(deaths) AS d_std, avg(affected) AS a_avg, stddev_samp(affected) AS a_std FROM disasters GROUP BY 1) s
    ON s.disaster_type = d.disaster_type) d
WHERE greatest(m_score, d_score, a_score) IS NOT NULL""",
    "anomalies": """
SELECT id, event_name, disaster_type, country, region, start_date, end_date, last_updated, magnitude, deaths, affected, damage_kusd,
  source, lat, lon, anomaly_type
FROM odd_disasters""",
    "ranked": """
SELECT disaster_type, country, region, num_occurrences, total_impact_score,
  CAST(row_number() OVER (PARTITION BY disaster_type ORDER BY num_occurrences DESC, total_impact_score DESC, country, region) AS INTEGER) AS rank
FROM (SELECT disaster_type, country, region, count(*) AS num_occurrences,
    CAST(sum(CAST(deaths AS DECIMAL(28,6))) AS DOUBLE) * CAST(1 AS DOUBLE)
      + CAST(sum(CAST(damage_kusd AS DECIMAL(28,6))) AS DOUBLE) * CAST(0.001 AS DOUBLE) AS total_impact_score
  FROM disasters GROUP BY ALL)
QUALIFY rank <= 5""",
    "countries": """
SELECT country, disaster_count, total_deaths, total_damage, avg_recovery_days, vulnerability_index,
  CASE WHEN vulnerability_index >= 0.8 THEN 'Critical' WHEN vulnerability_index >= 0.6 THEN 'High'
       WHEN vulnerability_index >= 0.4 THEN 'Medium' ELSE 'Low' END AS vulnerability_label
FROM (SELECT *, (
    coalesce((total_deaths - min(total_deaths) OVER ()) / nullif(max(total_deaths) OVER () - min(total_deaths) OVER (), 0), CAST(0 AS DOUBLE))
  + coalesce((total_damage - min(total_damage) OVER ()) / nullif(max(total_damage) OVER () - min(total_damage) OVER (), 0), CAST(0 AS DOUBLE))
  + coalesce((avg_recovery_days - min(avg_recovery_days) OVER ()) / nullif(max(avg_recovery_days) OVER () - min(avg_recovery_days) OVER (), 0), CAST(0 AS DOUBLE))
  ) / 3 AS vulnerability_index
  FROM (SELECT country, count(*) AS disaster_count, CAST(sum(deaths) AS BIGINT) AS total_deaths,
      CAST(sum(CAST(damage_kusd AS DECIMAL(28,6))) AS DOUBLE) AS total_damage,
      CAST(sum(end_date - start_date) AS BIGINT) / count(*) AS avg_recovery_days
    FROM disasters GROUP BY country))""",
    "merged": """
SELECT CASE WHEN here > 1 THEN concat('merged_', type, '_', coord, '_', CAST(n AS VARCHAR)) ELSE id END AS id, type, time, latitude, longitude,
  CASE WHEN n > 1 THEN concat(place, ' (', CAST(n AS VARCHAR), CASE type WHEN 'earthquake' THEN ' earthquakes)' ELSE ' fires)' END) ELSE place END AS place,
  severity, magnitude, frp, n AS merged_count
FROM (SELECT *, count(*) OVER (PARTITION BY coord, type) AS n, count(*) OVER (PARTITION BY coord) AS here,
    row_number() OVER (PARTITION BY coord, type ORDER BY coalesce(magnitude, frp, 0) DESC, time DESC, id) AS pick
  FROM (SELECT *, concat(CAST(CAST(latitude AS DECIMAL(9,6)) AS VARCHAR), '_', CAST(CAST(longitude AS DECIMAL(9,6)) AS VARCHAR)) AS coord FROM events3))
WHERE pick = 1""",
}

def _with(query: str, own: dict[str, str] | None = None) -> str:
    """Put the views that a query reads, directly or not, in front of it, then its own ones."""
    own = own or {}
    used: set[str] = set()
    todo = [query, *own.values()]
    while todo:
        text = todo.pop()
        found = {name for name in VIEWS if re.search(rf"\b{name}\b", text)} - used
        used |= found
        todo += [VIEWS[name] for name in found]
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in used]
    parts += [f"{head} AS ({text})" for head, text in own.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\n{query}"


def _metrics(kind: str | None, avg: str, peak: str) -> str:
    where = f"WHERE type = '{kind}'" if kind else ""
    by = "severity" if kind else "type, severity"
    return f"""
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, {by}, count(*) AS event_count,
  CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) AS {avg}, max(value) AS {peak}
FROM (SELECT *, date_trunc('minute', time) AS window_start, coalesce(magnitude, frp) AS value FROM events4) {where}
GROUP BY window_start, {by}"""


def _cooldown(query: str, seconds: int) -> str:
    """The alerts by their definition: from an alert to the first candidate after the cooldown."""
    later = f"SELECT min(c.second) FROM combined c WHERE c.alert_key = f.alert_key AND c.second >= f.second + INTERVAL {seconds} SECOND"
    return _with(
        query,
        {
            "fired(alert_key, second)": f"""
SELECT alert_key, min(second) FROM combined GROUP BY alert_key
UNION ALL
SELECT f.alert_key, ({later}) FROM fired f WHERE f.second IS NOT NULL""",
            "alerts": """
SELECT event_type, severity, value, location, second AS alert_time, event_id FROM combined JOIN fired USING (alert_key, second)""",
        },
    )


_AS_OF = "(SELECT max(time) FROM {0})"
_ROUND1 = "floor({0} * CAST(10 AS DOUBLE) + 0.5) / CAST(10 AS DOUBLE)"
_CELL_FIELDS = ["type", "time", "latitude", "longitude", "place", "severity", "magnitude", "frp", "city", "country"]
_PLAIN = {"plain": """SELECT id, type, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, time AS moment, CAST(latitude AS DECIMAL(9,4)) AS latitude,
  CAST(longitude AS DECIMAL(9,4)) AS longitude, place, severity, CAST(magnitude AS DECIMAL(9,4)) AS magnitude,
  CAST(frp AS DECIMAL(12,2)) AS frp, city, country FROM events4"""}


def _cells(row_key: str) -> str:
    fields = [f for f in _CELL_FIELDS if f != row_key]
    return "\nUNION ALL\n".join(
        f"SELECT {row_key} AS row_key, 'info' AS family, '{f}' AS qualifier, epoch_us(moment) // 1000 AS ts, CAST({f} AS VARCHAR) AS value "
        f"FROM plain WHERE {f} IS NOT NULL"
        for f in fields
    )


def _b64(text: str) -> str:
    return f"to_base64(encode({text}))"


def _age(time: str, as_of: str) -> str:
    minutes = f"floor(date_diff('microsecond', {time}, {as_of}) / 60000000)"
    return f"""CASE WHEN {minutes} < 1 THEN 'Just now' WHEN {minutes} < 60 THEN concat(CAST(CAST({minutes} AS BIGINT) AS VARCHAR), 'm ago')
  WHEN {minutes} < 1440 THEN concat(CAST(CAST(floor({minutes} / 60) AS BIGINT) AS VARCHAR), 'h ago') ELSE strftime({time}, '%-m/%-d/%Y') END"""


_TWICE = "JOIN (SELECT 1 AS copy UNION ALL SELECT 2) ON copy = 1 OR CAST(id AS BIGINT) % 10 = 0"
_LAT5 = "CAST(CAST(latitude AS DECIMAL(9,5)) AS DOUBLE)"
_LON5 = "CAST(CAST(longitude AS DECIMAL(9,5)) AS DOUBLE)"
_FIRE_ID = """concat_ws('_', CAST(CAST(latitude AS DECIMAL(9,5)) AS VARCHAR), CAST(CAST(longitude AS DECIMAL(9,5)) AS VARCHAR),
  CASE WHEN k % 50 = 4 THEN '' ELSE strftime(time, '%Y-%m-%d') END,
  CASE WHEN k % 50 = 1 THEN '2460' ELSE CAST(CAST(strftime(time, '%H%M') AS INTEGER) AS VARCHAR) END)"""
_EONET = """(SELECT id, 'EONET' AS source, CASE WHEN k % 20 = 11 THEN NULL ELSE date_trunc('second', time) + to_days(recovery_days) END AS last_modified,
  CASE WHEN k % 20 = 9 THEN 'N/A' ELSE place END AS event_name, 'N/A' AS alert_level,
  CASE WHEN k % 20 IN (5, 11) THEN 'N/A' ELSE printf('%.2f, %.2f', CAST(CAST(latitude AS DECIMAL(9,1)) AS DOUBLE), CAST(CAST(longitude AS DECIMAL(9,1)) AS DOUBLE)) END AS location,
  CASE WHEN k % 20 = 7 THEN '' ELSE concat(disaster_type, ', ', region) END AS type,
  CASE WHEN k % 20 = 11 THEN NULL ELSE date_trunc('second', time) END AS from_date,
  CASE WHEN k % 20 = 11 THEN NULL ELSE date_trunc('second', time) + to_days(recovery_days) END AS to_date,
  'N/A' AS affected_countries, concat('https://example.com/event/', id) AS url, k FROM hazard)"""
_ALERT_TEXTS = """
SELECT event_type, severity, value, location, alert_time, event_id, concat('ALERT: ', severity, ' ', kind, ' Detected') AS subject,
  concat('ALERT: ', severity, ' ', kind, ' Detected', chr(10), 'Details:', chr(10), '- Type: ', event_type, chr(10), '- Severity: ', severity, chr(10),
    '- Value: ', CAST(value AS VARCHAR), chr(10), '- Location: ', location, chr(10), '- Time: ', strftime(alert_time, '%Y-%m-%d %H:%M:%S')) AS body,
  concat('🚨 *', severity, ' ', kind, ' Alert*', chr(10), '*Value:* ', CAST(value AS VARCHAR), chr(10), '*Location:* ', location, chr(10),
    '*Time:* ', strftime(alert_time, '%Y-%m-%d %H:%M:%S')) AS webhook_text
FROM (SELECT *, CASE event_type WHEN 'earthquake' THEN 'Earthquake' ELSE 'Fire' END AS kind FROM alerts)"""


def oracle_sql() -> dict[str, str]:
    as_of3, as_of4 = _AS_OF.format("events3"), _AS_OF.format("events4")
    plain = {
        # sources and messages
        "decode_events": f"""
SELECT 'earthquake' AS kind, id, date_trunc('second', time) AS time, magnitude AS value, place, latitude, longitude,
  time + INTERVAL 1 SECOND AS kafka_timestamp FROM quakes {_TWICE}
UNION ALL
SELECT 'fire', id, date_trunc('second', time), frp, NULL, {_LAT5}, {_LON5}, time + INTERVAL 1 SECOND FROM fires {_TWICE}""",
        "ingest_geojson": f"""
SELECT id, date_trunc('millisecond', time) AS time, CASE WHEN k % 13 <> 0 THEN magnitude END AS magnitude,
  CASE WHEN k % 17 <> 0 THEN place ELSE 'Unknown location' END AS place, concat('https://example.com/quake/', id) AS url,
  'earthquake' AS feed_type, 'reviewed' AS status, 'ml' AS "magType", latitude, longitude,
  CASE WHEN k % 17 <> 0 THEN city ELSE 'Unknown' END AS city, CASE WHEN k % 17 <> 0 THEN country ELSE 'Unknown' END AS country,
  {_ROUND1.format("CASE WHEN k % 13 <> 0 THEN magnitude ELSE 0 END")} AS shown_magnitude
FROM quakes {_TWICE}""",
        "ingest_fire_csv": f"""
SELECT {_FIRE_ID} AS id, date_trunc('minute', time) AS time, frp, {_LAT5} AS latitude, {_LON5} AS longitude, place, city, country
FROM fires WHERE k % 50 NOT IN (1, 2, 3, 4)""",
        "rejects": f"""
SELECT {_FIRE_ID} AS id, CASE k % 50 WHEN 1 THEN 'acquisition time unreadable' WHEN 2 THEN 'power not a number'
  WHEN 3 THEN 'coordinate or power missing' ELSE 'acquisition date or time missing' END AS reason
FROM fires WHERE k % 50 IN (1, 2, 3, 4)""",
        "message_rejects": """
SELECT time + INTERVAL 1 SECOND AS timestamp, 'no readable id' AS reason FROM hazard WHERE type IS NOT NULL AND k % 10 IN (3, 6)""",
        "ingest_eonet": f"SELECT * EXCLUDE (k, copy) FROM {_EONET} {_TWICE}",
        "new_events_only": f"SELECT * EXCLUDE (k) FROM {_EONET} WHERE id NOT IN (SELECT id FROM hazard WHERE time < TIMESTAMP '2024-01-15 00:00:00')",
        "high_water_mark": f"SELECT max(last_modified) AS high_water_mark, count(*) AS row_count FROM {_EONET} {_TWICE}",
        "publish_json": _with(
            """
SELECT id AS key, concat('{"id":"', id, '","type":"', type, '","time":"', time, '","latitude":', CAST(latitude AS VARCHAR), ',"longitude":', CAST(longitude AS VARCHAR),
  ',"place":"', place, '","severity":"', severity, '","magnitude":', coalesce(CAST(magnitude AS VARCHAR), 'null'), ',"frp":', coalesce(CAST(frp AS VARCHAR), 'null'),
  ',"city":"', city, '","country":"', country, '"}') AS value
FROM plain""",
            _PLAIN,
        ),
        # cells
        "event_cells": _with(
            f"""
SELECT {_b64("row_key")} AS key, {_b64("concat(family, ':', qualifier)")} AS "column", ts AS timestamp, {_b64("value")} AS cell
FROM ({_cells("id")})""",
            _PLAIN,
        ),
        "latest_cells": _with(
            f"""
SELECT row_key, family, qualifier, ts, value FROM ({_cells("country")})
QUALIFY row_number() OVER (PARTITION BY row_key, family, qualifier ORDER BY ts DESC, value DESC) = 1""",
            _PLAIN,
        ),
        "rowkey_struct": """
SELECT id AS rowkey, 'info' AS cf, id, type, time, latitude, longitude, place, severity, magnitude, frp, city, country FROM events4""",
        # unified events and filters
        "unified_events": "SELECT * FROM events4",
        "dedupe_events": "SELECT * FROM events4",
        "fire_lookback": f"SELECT id, time, frp, latitude, longitude, place, city, country FROM fires WHERE time >= {as_of4} - INTERVAL 181 MINUTE",
        "time_range": f"SELECT * FROM events3 WHERE time >= {as_of3} - INTERVAL 12 HOUR",
        "event_filter": "SELECT * FROM events3 WHERE type = 'fire' AND severity = 'high'",
        "event_search": "SELECT * FROM events3 WHERE contains(lower(place), 'america') OR contains(lower(type), 'america')",
        "event_feed": f"SELECT *, {_age('time', as_of3)} AS age, concat(upper(left(severity, 1)), substr(severity, 2)) AS severity_text, "
        "concat(upper(left(type, 1)), substr(type, 2)) AS type_text FROM events3",
        "page": f"""
SELECT *, (SELECT count(*) FROM events3) AS total_results, CAST(11 AS BIGINT) AS from_row, least(CAST(20 AS BIGINT), (SELECT count(*) FROM events3)) AS to_row
FROM events3 ORDER BY time DESC, id LIMIT 10 OFFSET 10""",
        "page_after": """
SELECT * FROM events3 WHERE time < (SELECT max(time) FROM events3) OR time = (SELECT max(time) FROM events3) AND id > '' ORDER BY time DESC, id LIMIT 10""",
        "severity_quake4": """
SELECT id, magnitude, CASE WHEN magnitude IS NULL THEN 'Unknown' WHEN magnitude < 4 THEN 'Low' WHEN magnitude < 6 THEN 'Moderate'
  WHEN magnitude < 7 THEN 'High' ELSE 'Extreme' END AS severity FROM hazard""",
        "severity_fire4": """
SELECT id, frp, CASE WHEN frp IS NULL THEN 'Unknown' WHEN frp < 5 THEN 'Low' WHEN frp < 15 THEN 'Moderate'
  WHEN frp < 50 THEN 'High' ELSE 'Extreme' END AS severity FROM hazard""",
        "severity3": """
SELECT id, CASE WHEN magnitude IS NULL THEN 'Unknown' WHEN magnitude < 4 THEN 'low' WHEN magnitude < 6 THEN 'moderate' ELSE 'high' END AS quake_severity,
  CASE WHEN frp IS NULL THEN 'Unknown' WHEN frp < 5 THEN 'low' WHEN frp < 15 THEN 'moderate' ELSE 'high' END AS fire_severity FROM hazard""",
        "region_of": "SELECT id, earth_region AS region, split_part(earth_region, '/', 1) AS city FROM regions",
        "place_parts": "SELECT id, trim(split_part(split_part(place, ' of ', 2), ',', 1)) AS city, trim(split_part(place, ',', -1)) AS country FROM hazard",
        "place_parts_legacy": "SELECT id, trim(split_part(place, ',', 1)) AS city, trim(split_part(place, ',', 2)) AS country FROM hazard",
        # metrics
        "quake_metrics": _metrics("earthquake", "avg_magnitude", "max_magnitude"),
        "fire_metrics": _metrics("fire", "avg_frp", "max_frp"),
        "window_metrics": _metrics(None, "avg_value", "max_value"),
        "stream_metrics": f"SELECT * FROM ({_metrics(None, 'avg_value', 'max_value')}) WHERE window_end <= {as_of4} - INTERVAL 2 HOUR",
        "kpi_cards": f"""
SELECT count(*) AS total_events, count(*) FILTER (type = 'earthquake') AS earthquake_events, count(*) FILTER (type = 'fire') AS fire_events,
  coalesce({_ROUND1.format("(CAST(sum(CAST(coalesce(magnitude, 0) AS DECIMAL(28,6))) FILTER (type = 'earthquake') AS DOUBLE) / nullif(count(*) FILTER (type = 'earthquake'), 0))")}, 0) AS avg_magnitude,
  coalesce({_ROUND1.format("(CAST(sum(CAST(coalesce(frp, 0) AS DECIMAL(28,6))) FILTER (type = 'fire') AS DOUBLE) / nullif(count(*) FILTER (type = 'fire'), 0))")}, 0) AS avg_frp,
  count(*) FILTER (severity = 'high') AS high_severity_events, count(*) FILTER (time > {as_of3} - INTERVAL 1 HOUR) AS recent_events
FROM events3""",
        "severity_distribution": """
SELECT severity, count(id) AS event_count, floor(count(id) * 100 / sum(count(id)) OVER () + 0.5)::DOUBLE AS percentage
FROM (SELECT unnest(['high', 'moderate', 'low']) AS severity) LEFT JOIN events3 USING (severity) GROUP BY severity""",
        "event_trend": f"""
SELECT CAST(b AS INTEGER) AS bucket, bucket_start, strftime(bucket_start, '%I:%M %p') AS label, event_count,
  event_count / nullif(max(event_count) OVER (), 0) AS intensity, coalesce(event_count / nullif(max(event_count) OVER (), 0) > 0.7, false) AS is_strong
FROM (SELECT b, any_value(bucket_start) AS bucket_start, count(id) AS event_count
  FROM (SELECT b, {as_of3} - INTERVAL 12 HOUR + to_hours(CAST(b AS INTEGER)) AS bucket_start FROM range(12) r(b)) g
  LEFT JOIN events3 e ON e.time > bucket_start AND e.time <= bucket_start + INTERVAL 1 HOUR GROUP BY b)""",
        "event_bounds": """
SELECT min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north, count(*) AS event_count FROM events3""",
        # places and map
        "reverse_geocode": """
SELECT h.id, coalesce(n.city, 'Unknown') AS city, coalesce(h.given, n.country, 'Unknown') AS country, n.place_id,
  floor(n.km * CAST(1000 AS DOUBLE) + 0.5) / CAST(1000 AS DOUBLE) AS distance_km
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN country END AS given, floor(latitude * 100 + 0.5) AS lat_c, floor(longitude * 100 + 0.5) AS lon_c FROM hazard) h
LEFT JOIN (SELECT * FROM (
    SELECT c.lat_c, c.lon_c, g.place_id, g.city, g.country, floor(1e6 * 2 * 6371.0088 * asin(least(1, sqrt(
        pow(sin(radians(g.lat - c.lat_c / 100) / 2), 2) + cos(radians(c.lat_c / 100)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - c.lon_c / 100) / 2), 2)
      ))) + 0.5) / 1e6 AS km
    FROM (SELECT DISTINCT floor(latitude * 100 + 0.5) AS lat_c, floor(longitude * 100 + 0.5) AS lon_c FROM hazard) c, gazetteer g)
  WHERE km <= 2000 QUALIFY row_number() OVER (PARTITION BY lat_c, lon_c ORDER BY km, place_id) = 1) n
  ON n.lat_c = h.lat_c AND n.lon_c = h.lon_c""",
        "merge_colocated": "SELECT * FROM merged",
        "resolve_ids": """
SELECT m.id AS wanted_id, e.id, e.type, e.time FROM merged m JOIN events3 e ON NOT starts_with(m.id, 'merged_') AND e.id = m.id
UNION ALL
SELECT wanted_id, id, type, time FROM (
  SELECT m.id AS wanted_id, e.id, e.type, e.time, row_number() OVER (PARTITION BY m.id ORDER BY e.time DESC, e.id DESC) AS pick
  FROM merged m JOIN events3 e ON starts_with(m.id, 'merged_') AND e.type = m.type
   AND CAST(e.latitude AS DECIMAL(9,6)) = CAST(m.latitude AS DECIMAL(9,6)) AND CAST(e.longitude AS DECIMAL(9,6)) = CAST(m.longitude AS DECIMAL(9,6)))
WHERE pick = 1""",
        "mercator_grid": """
SELECT CAST(floor(x / 30 + 0.5) * 30 AS BIGINT) AS cell_x, CAST(floor(y / 30 + 0.5) * 30 AS BIGINT) AS cell_y, count(*) AS event_count,
  CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS max_severity
FROM (SELECT severity, 400 + radians(longitude) * (1024 / (2 * pi())) AS x, 300 - ln(tan(pi() / 4 + radians(latitude) / 2)) * (1024 / (2 * pi())) AS y FROM events3)
GROUP BY 1, 2""",
        # alerts
        "alert_candidates": "SELECT * FROM candidates",
        "alerts_cooldown": _cooldown("SELECT * FROM alerts", 3600),
        "stream_alerts": _cooldown("SELECT * FROM alerts", 3600),
        "alert_messages": _cooldown(_ALERT_TEXTS, 60),
        "stream_dedupe": "SELECT id, type, time, severity, magnitude, frp FROM events4",
        # history
        "correlations": "SELECT * FROM pairs",
        "correlation_list": """
SELECT *, CASE days_between WHEN 0 THEN 'Same day' WHEN 1 THEN '1 day' ELSE concat(CAST(days_between AS VARCHAR), ' days') END AS days_text
FROM pairs WHERE (disaster_type_a = 'flood' OR disaster_type_b = 'flood') AND days_between = 2
  AND (contains(lower(country), '_1') OR contains(lower(event_name_a), '_1') OR contains(lower(event_name_b), '_1'))""",
        "correlation_choices": """
SELECT 'country' AS choice, country AS value FROM pairs UNION SELECT 'disaster_type', disaster_type_a FROM pairs
UNION SELECT 'disaster_type', disaster_type_b FROM pairs""",
        "anomalies": "SELECT * FROM anomalies",
        "anomaly_list": """
SELECT *, CASE WHEN magnitude IS NULL THEN 'N/A' WHEN magnitude * 8 = floor(magnitude * 8) AND magnitude * 100 - floor(magnitude * 100) = 0.5
  THEN printf('%.2f', magnitude + 0.001) ELSE printf('%.2f', magnitude) END AS magnitude_text,
  format('{:,}', deaths) AS deaths_text, format('{:,}', affected) AS affected_text
FROM anomalies WHERE year(start_date) BETWEEN 2000 AND 2024 AND anomaly_type = 'deaths'""",
        "hotspots": "SELECT * FROM ranked",
        "hotspot_list": "SELECT * FROM ranked WHERE disaster_type = 'flood'",
        "vulnerability": "SELECT * FROM countries",
        "vulnerability_summary": """
SELECT count(*) AS total_countries, floor(CAST(sum(CAST(vulnerability_index AS DECIMAL(28,6))) AS DOUBLE) / count(*) * CAST(100 AS DOUBLE) + 0.5) / CAST(100 AS DOUBLE) AS average_index,
  count(*) FILTER (vulnerability_index >= 0.8) AS critical_countries FROM countries""",
        "vulnerability_list": "SELECT * FROM countries WHERE contains(lower(country), 'nation_1')",
    }
    plain["stream_cells"] = plain["event_cells"]
    plain["reverse_geocode_indexed"] = plain["reverse_geocode"]
    plain["anomalies_incremental"] = plain["anomalies"]
    plain["tile_pyramid"] = """
SELECT zoom, tile_x, tile_y, count(*) AS event_count, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS max_severity
FROM (SELECT severity, CAST(zoom AS INTEGER) AS zoom, CAST(floor((longitude + 180) / 360 * (2 ** zoom)) AS INTEGER) AS tile_x,
    CAST(floor((1 - ln(tan(pi() / 4 + radians(latitude) / 2)) / pi()) / 2 * (2 ** zoom)) AS INTEGER) AS tile_y
  FROM events3, generate_series(0, 10) AS g(zoom))
GROUP BY ALL"""
    total = "(SELECT count(*) FROM events3)"
    plain["page_deep"] = f"""
SELECT *, {total} AS total_results, CAST(296 AS BIGINT) AS from_row, least(CAST(300 AS BIGINT), {total}) AS to_row FROM events3 ORDER BY time DESC, id LIMIT 5 OFFSET 295"""
    plain["search_indexed"] = plain["event_search"]
    plain["merge_cells"] = plain["latest_cells"]
    plain["ingest_geojson_split"] = plain["ingest_geojson"]
    plain["incremental_load"] = f"""
SELECT *, max(last_modified) OVER (PARTITION BY load_id) AS mark, count(*) OVER (PARTITION BY load_id) AS row_count FROM (
SELECT id, CASE WHEN last_modified < TIMESTAMP '2024-01-26 00:00:00' THEN 'a' WHEN last_modified < TIMESTAMP '2024-02-12 00:00:00' THEN 'b' ELSE 'c' END AS load_id,
  last_modified, event_name, type, location, url FROM {_EONET})"""
    plain["stream_alerts_ordered"] = _cooldown(f"SELECT * FROM alerts WHERE alert_time + INTERVAL 1 SECOND <= {as_of4} - INTERVAL 2 HOUR", 3600)
    known = "CASE WHEN k % 17 <> 0 THEN {} ELSE '{}' END"
    plain["stream_publish"] = f"""
SELECT id AS key, concat('{{"id":"', id, '","time":"', strftime(time, '%Y-%m-%d %H:%M:%S'), '","place":"', {known.format("place", "Unknown location")},
  '","url":"https://example.com/quake/', id, '","city":"', {known.format("city", "Unknown")}, '","country":"', {known.format("country", "Unknown")}, '"}}') AS value
FROM quakes"""
    return {name: text if text.startswith("WITH ") else _with(text.strip()) for name, text in plain.items()}

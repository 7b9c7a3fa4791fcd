"""Landed feed files to rows: earthquake GeoJSON, fire CSV, natural-event JSON.

Each ``read_*`` only opens files with an explicit schema; each ``*_rows`` function is a narrow
transformation (no shuffle) that also accepts payload text decoded with ``decode_payload``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens import schemas
from hazardlens.functions import places
from hazardlens.functions.numbers import finite, round_to
from hazardlens.functions.rows import evaluate_once
from hazardlens.functions.times import EPOCH, utc_from_text
from hazardlens.sources import members


def decode_payload(payloads: DataFrame, schema: StructType, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One feed document per row of text, parsed once; malformed documents give NULL fields. Columns ``keep`` stay beside it."""
    return payloads.select(*keep, F.inline(F.array(F.from_json(F.col(column), schema))))


def read_geojson(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """Feed documents; with ``lines`` one document per line, the form for archives, as such files split over tasks."""
    return spark.read.schema(schemas.GEOJSON).json(path, multiLine=not lines)


def read_natural_events(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """As ``read_geojson``, for natural-event documents."""
    return spark.read.schema(schemas.NATURAL_EVENTS).json(path, multiLine=not lines)


def read_geojson_split(spark: SparkSession, path) -> DataFrame:
    """As ``read_geojson`` for collections of any size: a file is read by as many tasks as it has splits, a feature a row."""
    return members.as_documents(members.read_members(spark, path, "features"), schemas.GEOJSON, "features")


def read_natural_events_split(spark: SparkSession, path) -> DataFrame:
    """As ``read_geojson_split``, for natural-event documents."""
    return members.as_documents(members.read_members(spark, path, "events"), schemas.NATURAL_EVENTS, "events")


def read_fire_csv(spark: SparkSession, path) -> DataFrame:
    """Columns are matched by the header of each file and stay text; files may differ in order and in extra columns.

    Only the distinct headers and the names of the files come to the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    is_header = F.lit(True)
    for name in schemas.FIRE_CSV_COLUMNS:
        is_header = is_header & F.array_contains(F.transform(F.split("value", ","), lambda c: F.trim(F.translate(c, '"\ufeff', ""))), name)
    headers = lines.filter(is_header).groupBy("file").agg(F.min("value").alias("header"))
    by_header = headers.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    if not by_header:
        return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    parts = [spark.read.csv(r["files"], header=True, inferSchema=False, enforceSchema=False) for r in by_header]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def utc_from_millis(millis: Column) -> Column:
    """Epoch milliseconds as a zone-free UTC time."""
    span = F.make_dt_interval(secs=(millis / F.lit(1000)).cast("decimal(18,6)"))
    return F.expr(EPOCH) + span


def quake_rows(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature with an id; coordinates come from the geometry. Columns ``keep`` of the document follow."""
    f = documents.select(*keep, F.explode("features").alias("f")).select("f.id", "f.properties", "f.geometry.coordinates", *keep)
    place = F.col("properties.place")
    return f.filter(F.col("id").isNotNull()).select(
        "id",
        utc_from_millis(F.col("properties.time")).alias("time"),
        F.col("properties.mag").alias("magnitude"),
        F.coalesce(F.nullif(place, F.lit("")), F.lit("Unknown location")).alias("place"),
        F.col("properties.url").alias("url"),
        F.col("properties.type").alias("feed_type"),
        F.col("properties.status").alias("status"),
        F.col("properties.magType").alias("magType"),
        F.get("coordinates", F.lit(1)).alias("latitude"),
        F.get("coordinates", F.lit(0)).alias("longitude"),
        places.city_of(place).alias("city"),
        places.country_of(place).alias("country"),
        round_to(F.coalesce(F.col("properties.mag"), F.lit(0.0)), 1).alias("shown_magnitude"),
        *keep,
    )


def _blank(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) == 0


def fire_rows_checked(raw: DataFrame, id_prefix: str = "", missing_clock: str | None = None) -> DataFrame:
    """Every CSV row with its parsed fields and a ``reason`` that is NULL for good rows.

    ``id_prefix`` stands before the composite id; ``missing_clock``, such as "0000", stands for a missing time of day.
    """
    if missing_clock is not None:
        raw = raw.withColumn("acq_time", F.when(_blank("acq_time"), F.lit(missing_clock)).otherwise(F.col("acq_time")))
    clock = F.trim("acq_time")
    padded = F.lpad(clock, 4, "0")
    stamp = F.concat(F.trim("acq_date"), F.lit(" "), F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2))
    parsed = raw.select(
        *schemas.FIRE_CSV_COLUMNS,
        F.concat(F.lit(id_prefix), F.concat_ws("_", *[F.trim(F.coalesce(c, F.lit(""))) for c in schemas.FIRE_CSV_COLUMNS[:4]])).alias("id"),
        F.when(F.length(clock) <= 4, stamp.try_cast("timestamp_ntz")).alias("time"),
        finite(F.trim("frp").try_cast("double")).alias("frp_value"),
        finite(F.trim("latitude").try_cast("double")).alias("lat"),
        finite(F.trim("longitude").try_cast("double")).alias("lon"),
    )
    reason = (
        F.when(_blank("acq_date") | _blank("acq_time"), "acquisition date or time missing")
        .when(_blank("latitude") | _blank("longitude") | _blank("frp"), "coordinate or power missing")
        .when(F.col("time").isNull(), "acquisition time unreadable")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "coordinate not a number")
        .when(F.col("frp_value").isNull(), "power not a number")
    )
    return evaluate_once(parsed, *parsed.columns[5:], reason.alias("reason"), beside=list(schemas.FIRE_CSV_COLUMNS))


def fire_rows(raw: DataFrame, id_prefix: str = "", missing_clock: str | None = None) -> DataFrame:
    """Good fire rows; place, city and country are derived from the region of the point."""
    good = fire_rows_checked(raw, id_prefix, missing_clock).filter(F.col("reason").isNull())
    return good.select(
        "id", "time", F.col("frp_value").alias("frp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        places.region_of(F.col("lat"), F.col("lon")).alias("place"),
    ).withColumns({"city": places.region_city(F.col("place")), "country": F.col("place")})


def fire_rejects(raw: DataFrame) -> DataFrame:
    """Rows that ``fire_rows`` leaves out, with the reason; write them to a side table."""
    return fire_rows_checked(raw).filter(F.col("reason").isNotNull()).select("id", *schemas.FIRE_CSV_COLUMNS, "reason")


def natural_event_rows(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event: first and last geometry date, joined categories, last point as text; columns ``keep`` follow."""
    e = documents.select(*keep, F.explode("events").alias("e")).select("e.*", *keep)
    n = F.coalesce(F.size("geometry"), F.lit(0))
    last = F.get("geometry", F.greatest(n - 1, F.lit(0)))
    first_date = utc_from_text(F.get("geometry", F.lit(0))["date"])
    last_date = utc_from_text(last["date"])
    e = e.withColumn("point", F.from_json(last["coordinates"], "array<double>"))
    lon, lat = F.get("point", F.lit(0)), F.get("point", F.lit(1))
    is_point = (F.size("point") == 2) & lon.isNotNull() & lat.isNotNull()
    titles = F.transform("categories", lambda c: F.coalesce(c["title"], F.lit("N/A")))
    return e.select(
        F.coalesce("id", F.lit("unknown")).alias("id"),
        F.lit("EONET").alias("source"),
        last_date.alias("last_modified"),
        F.coalesce("title", F.lit("N/A")).alias("event_name"),
        F.lit("N/A").alias("alert_level"),
        F.when(is_point, F.format_string("%.2f, %.2f", lat, lon)).otherwise(F.lit("N/A")).alias("location"),
        F.coalesce(F.array_join(titles, ", "), F.lit("")).alias("type"),
        first_date.alias("from_date"),
        last_date.alias("to_date"),
        F.lit("N/A").alias("affected_countries"),
        F.coalesce("link", F.lit("N/A")).alias("url"),
        *keep,
    )


def new_rows_only(incoming: DataFrame, loaded: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not loaded yet, one per key (the latest, ties by the other columns).

    The incoming copies of a key collapse map-side before anything is joined, so a key that
    is published again and again costs one row per task.
    """
    rest = [c for c in incoming.columns if c not in (key, "last_modified")]
    order = (["last_modified"] if "last_modified" in incoming.columns else []) + rest
    newest = incoming.groupBy(key).agg(F.max(F.struct(*order)).alias("row")).select(key, "row.*")
    return newest.join(loaded.select(key), key, "left_anti").select(*incoming.columns)


def high_water_mark(rows: DataFrame, column: str = "last_modified") -> DataFrame:
    """One row: the bound from which the next load continues, and how many rows it covers."""
    return rows.agg(F.max(column).alias("high_water_mark"), F.count("*").alias("row_count"))


def since(rows: DataFrame, mark: Column, column: str = "last_modified") -> DataFrame:
    """Rows from a stored high-water mark on, and rows without a time.

    Rows with the time of the mark may have come after it was taken; ``new_rows_only`` drops what is loaded already.
    """
    return rows.filter((F.col(column) >= mark) | F.col(column).isNull())

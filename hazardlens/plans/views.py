"""Hazard views over the driver tables: what the operators read in the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from hazardlens import params
from hazardlens.functions import places
from hazardlens.operators.events import graded, unify
from hazardlens.schemas import HAZARD_EVENT
from hazardlens.sources import feeds
from hazardlens.sources.tables import read_events, shared_folder
from hazardlens.sources.topic import file_stream

EVENTS_SCHEMA = StructType(
    [
        StructField("event_id", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("user_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
        StructField("props", StringType()),
    ]
)

# The event kind of the driver table behind each disaster type.
DISASTER_OF = {"error": "earthquake", "click": "wildfire", "view": "flood", "signup": "storm"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_events(spark, f"{sf_dir}/{name}.parquet")


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of the newest earthquake or fire, from two columns of the event table and without its joins."""
    live = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "click"))
    return live.agg(F.max("ts").alias("as_of"))


def events_stream(
    spark: SparkSession, sf_dir: str, parts: int = 3, mixed: bool = False
) -> tuple[DataFrame, list[Callable[[], None]]]:
    """The event table as files that arrive in the order of their times, and the arrivals that are still to come.

    Each arrival lands the next stretch of time in a folder under the shared one; the first has landed. Event time has
    the timestamp type that watermarks need; events without one are in the first stretch. With ``mixed`` every fifth event
    of the hour before a cut lands with the stretch behind it.
    """
    events = table(spark, sf_dir, "events")
    folder = shared_folder(spark, "arriving")
    cuts = _cuts(events, parts)

    def before(i: int) -> Column:
        cut = F.lit(cuts[i]).cast("timestamp_ntz")
        held = (F.col("ts") >= cut - F.make_dt_interval(hours=F.lit(1))) & (F.col("event_id") % 5 == 0)
        return (F.col("ts") < cut) & ~held if mixed else F.col("ts") < cut

    def land(i: int) -> None:
        own = F.lit(True)
        if i:
            own = own & ~before(i - 1)
        if i < len(cuts):
            own = own & before(i)
        (events.filter(own) if i else events.filter(own | F.col("ts").isNull())).write.mode("append").parquet(folder)

    land(0)
    stream = file_stream(spark, folder, EVENTS_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream, [partial(land, i) for i in range(1, len(cuts) + 1)]


def _cuts(events: DataFrame, parts: int) -> list:
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    return [] if low is None else [low + (high - low) * i / parts for i in range(1, parts)]


def payload_arrivals(spark: SparkSession, sf_dir: str, parts: int = 3) -> tuple[str, list[Callable[[], None]]]:
    """A folder of earthquake documents, a line each, and the arrivals that are still to come; each brings the next stretch of
    time and the one before it again. The first has landed."""
    events, folder = table(spark, sf_dir, "events"), shared_folder(spark, "payloads")
    cuts = _cuts(events, parts)
    stretch = F.lit(0)
    for cut in cuts:
        stretch = stretch + F.coalesce(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"), F.lit(False)).cast("int")

    def land(i: int) -> None:
        own = events.filter(stretch.between(i - 1, i))
        geojson_payloads(hazard_of(own, table(spark, sf_dir, "nation"))).write.mode("append").text(folder)

    land(0)
    return folder, [partial(land, i) for i in range(1, len(cuts) + 1)]


def hazard_of(events: DataFrame, nation: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    disaster = F.lit("volcanic_activity")
    for name, disaster_type in DISASTER_OF.items():
        disaster = F.when(kind == name, F.lit(disaster_type)).otherwise(disaster)
    e = events.withColumns(
        {"k": F.regexp_extract("props", "[0-9]+", 0).cast("bigint"), "n_nationkey": F.pmod("user_id", F.lit(25))}
    ).join(nation.select("n_nationkey", "n_name"), "n_nationkey", "left")
    user, k = F.col("user_id"), F.col("k")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("time"),
        disaster.alias("disaster_type"),
        F.when(kind == "error", F.lit("earthquake")).when(kind == "click", F.lit("fire")).alias("type"),
        F.when(kind == "error", F.least(value / 20, F.lit(9.5))).alias("magnitude"),
        F.when(kind == "click", value).alias("frp"),
        ((user * 37 % 1701).cast("double") / 10 - 85).alias("latitude"),
        (((k * 73 + user * 11) % 3600).cast("double") / 10 - 180).alias("longitude"),
        F.concat(k.cast("string"), F.lit("km NE of City"), user.cast("string"), F.lit(", "), F.col("n_name")).alias("place"),
        F.col("n_name").alias("country"),
        F.concat("n_name", F.lit("_S"), (F.floor(user / 25) % 4).cast("string")).alias("region"),
        (k * k).alias("deaths"),
        F.floor(value * 100 + 0.5).cast("bigint").alias("damage_kusd"),
        (k % 60).cast("int").alias("recovery_days"),
        k.alias("k"),
        kind.alias("event_type"),
    )


def hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hazard_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def quakes_of(h: DataFrame) -> DataFrame:
    return h.filter(F.col("event_type") == "error").select(
        "id", "time", "magnitude", "place", "latitude", "longitude",
        places.city_of(F.col("place")).alias("city"), places.country_of(F.col("place")).alias("country"),
    )


def fires_of(h: DataFrame) -> DataFrame:
    region = places.region_of(F.col("latitude"), F.col("longitude"))
    return (
        h.filter(F.col("event_type") == "click")
        .select("id", "time", "frp", "latitude", "longitude", region.alias("place"))
        .withColumns({"city": places.region_city(F.col("place")), "country": F.col("place")})
    )


def _grades(levels: int):
    if levels == 4:
        return params.QUAKE_GRADES_4, params.FIRE_GRADES_4
    return params.QUAKE_GRADES_3, params.FIRE_GRADES_3


def events_of(h: DataFrame, levels: int = 4) -> DataFrame:
    """Earthquakes and fires of one hazard table in one pass over it."""
    region = places.region_of(F.col("latitude"), F.col("longitude"))
    quake = F.col("type") == "earthquake"
    named = h.filter(F.col("event_type").isin("error", "click")).withColumn(
        "place", F.when(quake, F.col("place")).otherwise(region)
    )
    city = F.when(quake, places.city_of(F.col("place"))).otherwise(places.region_city(F.col("place")))
    country = F.when(quake, places.country_of(F.col("place"))).otherwise(F.col("place"))
    return graded(named.withColumns({"city": city, "country": country}), *_grades(levels)).select(*HAZARD_EVENT.names)


def united_events(h: DataFrame, levels: int = 4) -> DataFrame:
    """The same rows from two tables, one per kind, as two feeds deliver them."""
    return unify(quakes_of(h), fires_of(h), *_grades(levels))


def events(spark: SparkSession, sf_dir: str, levels: int = 4) -> DataFrame:
    return events_of(hazard(spark, sf_dir), levels)


def disasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date("time")
    end = F.date_add(start, F.col("recovery_days"))
    return hazard(spark, sf_dir).select(
        "id", F.concat_ws(" ", "disaster_type", "region").alias("event_name"), "disaster_type", "country", "region",
        start.alias("start_date"), end.alias("end_date"), end.alias("last_updated"), "magnitude", "deaths",
        F.col("damage_kusd").alias("affected"), F.col("damage_kusd").cast("double").alias("damage_kusd"),
        F.concat(F.lit("https://example.com/disaster/"), F.col("id")).alias("source"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    key, name = F.col("s_suppkey"), F.col("s_name")
    return s.join(table(spark, sf_dir, "nation"), "n_nationkey").select(
        key.alias("place_id"),
        ((key * 131 % 1401).cast("double") / 10 - 70).alias("lat"),
        ((key * 977 % 3600).cast("double") / 10 - 180).alias("lon"),
        F.when(key % 4 == 0, name).alias("city"),
        F.when(key % 4 == 1, name).alias("town"),
        F.when(key % 4 == 2, name).alias("village"),
        F.col("n_name").alias("country"),
    )


# Feeds: the views written out as feed payloads, every tenth row twice, with the odd rows that
# real feeds have. The queries parse them back.


def _copies() -> Column:
    return F.when(F.col("id").cast("bigint") % 10 == 0, F.lit(2)).otherwise(F.lit(1))


def _doubled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), _copies())))


def geojson_payloads(h: DataFrame, *keep: Column) -> DataFrame:
    """One feature collection per earthquake; magnitude and place are missing now and then."""
    k = F.col("k")
    props = F.struct(
        F.when(k % 13 != 0, F.col("magnitude")).alias("mag"),
        F.when(k % 17 != 0, F.col("place")).alias("place"),
        F.timestamp_diff("MILLISECOND", F.expr(feeds.EPOCH), F.col("time")).alias("time"),
        F.concat(F.lit("https://example.com/quake/"), F.col("id")).alias("url"),
        F.lit("earthquake").alias("type"), F.lit("reviewed").alias("status"), F.lit("ml").alias("magType"),
    )
    geometry = F.struct(F.array("longitude", "latitude", F.lit(10.0)).alias("coordinates"))
    feature = F.struct("id", props.alias("properties"), geometry.alias("geometry"))
    features = F.array_repeat(feature, _copies()).alias("features")
    return h.filter(F.col("event_type") == "error").select(F.to_json(F.struct(features)).alias("value"), *keep)


def collection_files(documents: DataFrame, member: str, folder: str) -> None:
    """Feed documents of one day each, as files: the objects of the documents (value, day) end to end in one array, behind
    and before what other keys hold."""
    body = documents.select("day", F.explode(F.from_json(F.get_json_object("value", f"$.{member}"), "array<string>")).alias("value"))
    order = Window.partitionBy("day").orderBy("value")
    numbered = body.select("day", "value", F.row_number().over(order).alias("n"), F.lead(F.lit(True)).over(order).isNull().alias("last"))
    head = F.lit('{"type":"FeatureCollection","metadata":{"note":"a { or \\"[ here","ids":[{"id":"x"}]},"' + member + '":[\n')
    foot = F.lit('\n],"others":[{"id":"y"}],"bbox":[-180,-90,180,90]}')
    # Head and foot go with the first and last object of a day. As rows of their own, in a union, they came to other files
    # than the day's objects: a union counts as dealt by day already, and its sides are then coalesced each by itself.
    line = F.concat(F.when(F.col("n") == 1, head).otherwise(","), "value", F.when(F.col("last"), foot).otherwise(""))
    lines = numbered.repartition("day").sortWithinPartitions("day", "n").select("day", line.alias("value"))
    lines.write.partitionBy("day").text(folder)


FIRE_CSV_HEADER = "latitude string, longitude string, bright_ti4 string, acq_date string, acq_time string, frp string, daynight string"


def fire_csv_lines(h: DataFrame) -> DataFrame:
    """Fire CSV lines; four of fifty kinds of row are broken in four ways."""
    odd = F.col("k") % 50
    text = [
        F.col("latitude").cast("decimal(9,5)").cast("string"),
        F.col("longitude").cast("decimal(9,5)").cast("string"),
        F.lit("330.1"),
        F.when(odd == 4, F.lit("")).otherwise(F.date_format("time", "yyyy-MM-dd")),
        F.when(odd == 1, F.lit("2460")).otherwise(F.date_format("time", "HHmm").cast("int").cast("string")),
        F.when(odd == 2, F.lit("n/a")).when(odd == 3, F.lit("")).otherwise(F.col("frp").cast("decimal(12,2)").cast("string")),
        F.lit("D"),
    ]
    return h.filter(F.col("event_type") == "click").select(F.concat_ws(",", *text).alias("value"))


def fire_csv_rows(h: DataFrame) -> DataFrame:
    return fire_csv_lines(h).select(F.inline(F.array(F.from_csv("value", FIRE_CSV_HEADER))))


def natural_event_payloads(h: DataFrame, *keep: Column) -> DataFrame:
    """One natural-event document per hazard row: a first point, then a last point or polygon."""
    def day(days):
        return F.date_format(F.col("time") + F.make_dt_interval(days=days), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    k = F.col("k")
    lon, lat = F.col("longitude").cast("decimal(9,1)").cast("string"), F.col("latitude").cast("decimal(9,1)").cast("string")
    point = F.concat(F.lit("["), lon, F.lit(","), lat, F.lit("]"))
    last = F.when(k % 20 == 5, F.concat(F.lit("["), point, F.lit(","), point, F.lit("]"))).otherwise(point)

    def spot(date, coordinates):
        return F.concat(F.lit('{"date":"'), date, F.lit('","coordinates":'), coordinates, F.lit("}"))

    def title(text):
        return F.concat(F.lit('{"title":"'), text, F.lit('"}'))

    categories = F.when(k % 20 == 7, F.lit("")).otherwise(F.concat_ws(",", title(F.col("disaster_type")), title(F.col("region"))))
    geometry = F.concat_ws(",", spot(day(F.lit(0)), point), spot(day(F.col("recovery_days")), last))
    body = F.concat(
        F.lit('{"id":"'), F.col("id"), F.lit('",'),
        F.when(k % 20 == 9, F.lit("")).otherwise(F.concat(F.lit('"title":"'), F.col("place"), F.lit('",'))),
        F.lit('"link":"https://example.com/event/'), F.col("id"), F.lit('","categories":['), categories, F.lit("]"),
        F.when(k % 20 == 11, F.lit("")).otherwise(F.concat(F.lit(',"geometry":['), geometry, F.lit("]"))),
        F.lit("}"),
    )
    documents = F.array_join(F.array_repeat(body, _copies()), ",")
    return h.select(F.concat(F.lit('{"events":['), documents, F.lit("]}")).alias("value"), *keep)


ARRIVALS = ("a", "b", "c")


def natural_event_arrivals(h: DataFrame) -> DataFrame:
    """(arrived, value): natural-event documents in three landings by their last change; each sends the one before it again."""
    changed = F.date_trunc("second", "time").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("recovery_days"))
    before = lambda day: (changed < F.lit(day).cast("timestamp_ntz")) & (F.col("k") % 20 != 11)
    first = F.when(before("2024-01-26"), F.array(F.lit("a"), F.lit("b"))).when(before("2024-02-12"), F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    return natural_event_payloads(h.withColumn("arrived", first), F.col("arrived")).select(F.explode("arrived").alias("arrived"), "value")


def messages(h: DataFrame, kind: str) -> DataFrame:
    """Topic messages of one type; fires carry their coordinates as quoted text.

    Beside the good messages (every tenth twice) there are unreadable ones and ones without id.
    """
    time = F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time")
    if kind == "earthquake":
        rows = h.filter(F.col("event_type") == "error")
        fields = [time, "magnitude", "place", F.lit("reviewed").alias("status"), "latitude", "longitude"]
    else:
        rows = h.filter(F.col("event_type") == "click")
        quoted = [F.col(c).cast("decimal(9,5)").cast("string").alias(c) for c in ("latitude", "longitude")]
        fields = [time, "frp", F.lit(None).cast("string").alias("city"), *quoted]
    # Variants of a row: sent, sent again, unreadable, without an id.
    variants = F.concat(
        F.array_repeat(F.lit("sent"), _copies()),
        F.when(F.col("k") % 10 == 3, F.array(F.lit("broken"))).when(F.col("k") % 10 == 6, F.array(F.lit("nameless"))).otherwise(F.array()),
    )
    kind_of = F.col("variant")
    key = F.when(kind_of != "nameless", F.col("id")).alias("id")
    text = F.to_json(F.struct(key, *fields))
    return rows.withColumn("variant", F.explode(variants)).select(
        F.concat(F.when(kind_of == "broken", F.lit("#")).otherwise(F.lit("")), text).alias("value"),
        (F.col("time") + F.make_dt_interval(secs=F.lit(1))).alias("timestamp"),
    )


def republished(events: DataFrame) -> DataFrame:
    """Events as a feed that sends every tenth one again, an hour later and with another place."""
    again = _doubled(events)
    second = F.col("copy") == 2
    return again.withColumns(
        {
            "time": F.when(second, F.col("time") + F.make_dt_interval(hours=F.lit(1))).otherwise(F.col("time")),
            "place": F.when(second, F.concat("place", F.lit(" (again)"))).otherwise(F.col("place")),
        }
    ).drop("copy")


def resent(events: DataFrame) -> DataFrame:
    """Events as a feed that sends every tenth one again unchanged."""
    return _doubled(events).drop("copy")

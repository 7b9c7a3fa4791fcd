"""Window metrics and dashboard aggregates, each one scan with map-side combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions.numbers import avg_of, prepared, round_to, sum_of
from hazardlens.operators.events import event_value, moment


def window_metrics(events: DataFrame, window: str = params.METRIC_WINDOW) -> DataFrame:
    """Count, average and maximum per tumbling window, type and severity.

    Used as it is on batch and on watermarked streaming input.
    """
    narrow = prepared(events.select("time", "type", "severity", event_value().alias("value")), ["time", "type", "severity", "value"], v=F.col("value"))
    return (
        narrow.groupBy(F.window("time", window).alias("w"), "type", "severity")
        .agg(
            F.count("*").alias("event_count"),
            avg_of("v").alias("avg_value"),
            F.max("value").alias("max_value"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "type", "severity", "event_count", "avg_value", "max_value",
        )
    )


def metrics_of_type(events: DataFrame, event_type: str, window: str = params.METRIC_WINDOW) -> DataFrame:
    """The metrics of one type, with the average and maximum named after its measure."""
    measure = "magnitude" if event_type == "earthquake" else "frp"
    return window_metrics(events.filter(F.col("type") == event_type), window).select(
        "window_start", "window_end", "severity", "event_count",
        F.col("avg_value").alias(f"avg_{measure}"),
        F.col("max_value").alias(f"max_{measure}"),
    )


def kpi_cards(events: DataFrame, as_of) -> DataFrame:
    """One row of totals; a missing value counts as 0 in the averages, no rows give 0.0."""
    quake, fire = F.col("type") == "earthquake", F.col("type") == "fire"
    recent = F.col("time") > moment(as_of, 3600)
    magnitude, power = F.when(quake, F.coalesce("magnitude", F.lit(0.0))), F.when(fire, F.coalesce("frp", F.lit(0.0)))
    sums = prepared(events, ["type", "time", "severity"], magnitude=magnitude, power=power).agg(
        F.count("*").alias("total_events"),
        F.count_if(quake).alias("earthquake_events"),
        F.count_if(fire).alias("fire_events"),
        sum_of("magnitude").alias("magnitudes"),
        sum_of("power").alias("powers"),
        F.count_if(F.lower("severity") == "high").alias("high_severity_events"),
        F.count_if(recent).alias("recent_events"),
    )

    def mean(total, n):
        return F.coalesce(round_to(F.col(total) / F.nullif(F.col(n), F.lit(0)), 1), F.lit(0.0))

    return sums.select(
        "total_events", "earthquake_events", "fire_events",
        mean("magnitudes", "earthquake_events").alias("avg_magnitude"),
        mean("powers", "fire_events").alias("avg_frp"),
        "high_severity_events", "recent_events",
    )


def severity_distribution(events: DataFrame, levels=("high", "moderate", "low")) -> DataFrame:
    """Count and share of every level, present or not, in either case, from one conditional aggregate.

    Events of any other level, or of none, are the row "other", which is there only if it counts something.
    """
    own = F.lower("severity")
    names = [*levels, "other"]
    other = F.count_if(~F.coalesce(own.isin(*levels), F.lit(False)))
    counts = events.agg(*[F.count_if(own == s).alias(s) for s in levels], other.alias("other"), F.count("*").alias("total"))
    rows = counts.select(
        "total", F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("event_count")) for s in names]))
    ).filter("severity <> 'other' OR event_count > 0")
    share = F.col("event_count") * 100 / F.nullif(F.col("total"), F.lit(0))
    return rows.select("severity", "event_count", F.coalesce(round_to(share, 0), F.lit(0.0)).alias("percentage"))


def event_trend(events: DataFrame, as_of, name: str, buckets: int = params.TREND_BUCKETS) -> DataFrame:
    """Event counts of equal buckets that tile (as_of - range, as_of], empty ones included."""
    width = params.TIME_RANGES[name] / buckets
    now, first = moment(as_of), moment(as_of, params.TIME_RANGES[name])
    micros = F.timestamp_diff("MICROSECOND", F.col("time"), now)
    back = F.floor(micros / F.lit(width * 1_000_000.0)).cast("int")
    counts = (
        events.filter((F.col("time") > first) & (F.col("time") <= now))
        .groupBy((F.lit(buckets - 1) - back).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    spark = events.sparkSession
    every = spark.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    # At most `buckets` count rows exist, and so many rows enter the window below.
    filled = every.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("event_count")
    )
    start = first + F.make_dt_interval(secs=(F.col("bucket") * F.lit(width)).cast("decimal(18,6)"))
    peak = F.nullif(F.max("event_count").over(Window.partitionBy()), F.lit(0))
    return (
        filled.withColumns({"bucket_start": start, "intensity": F.col("event_count") / peak})
        .withColumns(
            {
                "label": F.date_format("bucket_start", "hh:mm a"),
                "is_strong": F.coalesce(F.col("intensity") > params.STRONG_INTENSITY, F.lit(False)),
            }
        )
        .select("bucket", "bucket_start", "label", "event_count", "intensity", "is_strong")
    )


def event_bounds(events: DataFrame) -> DataFrame:
    """Bounding box of the shown events."""
    return events.agg(
        F.min("longitude").alias("west"), F.min("latitude").alias("south"),
        F.max("longitude").alias("east"), F.max("latitude").alias("north"),
        F.count("*").alias("event_count"),
    )

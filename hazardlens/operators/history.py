"""Historical views over disasters: correlated pairs, anomalies, hotspots, vulnerability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions.grading import vulnerability_label
from hazardlens.functions.numbers import exact_sum, finite, round_to
from hazardlens.functions.rows import evaluate_once
from hazardlens.operators.skew import hot_keys, salted_join


def correlations(disasters: DataFrame, days: int = params.CORRELATION_DAYS) -> DataFrame:
    """Pairs of disasters of different types in one country, the second 0 to ``days`` days after the first.

    Records with the same country, type, start date and name are one disaster and collapse
    map-side first; their number is kept beside each half of the pair. The band join becomes an
    equi join on (country, time bucket): a bucket spans days + 1, so the second event lies in
    the bucket of the first or in the next one. Crowded buckets are salted. On one day the
    smaller type name comes first, so each pair appears once.
    """
    span = days + 1
    day = F.datediff("start_date", F.lit("1970-01-01").cast("date"))
    one = (
        disasters.groupBy("country", "disaster_type", F.to_date("start_date").alias("start_date"), "event_name")
        .agg(F.count("*").alias("records"))
        .withColumn("day", day)
        .withColumn("bucket", F.floor(F.col("day") / F.lit(span)).cast("int"))
    )
    names = ["disaster_type", "start_date", "event_name", "records", "day"]
    first = one.select("country", "bucket", *[F.col(n).alias(f"{n}_a") for n in names])
    second = one.select(
        "country", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"),
        *[F.col(n).alias(f"{n}_b") for n in names],
    )
    crowded = hot_keys(one.groupBy("country", "bucket").agg(F.count("*").alias("rows")), ["country", "bucket"])
    pairs = salted_join(first, second, ["country", "bucket"], crowded)
    gap = F.col("day_b") - F.col("day_a")
    return pairs.filter(
        gap.between(0, days)
        & (F.col("disaster_type_a") != F.col("disaster_type_b"))
        & ((gap > 0) | (F.col("disaster_type_a") < F.col("disaster_type_b")))
    ).select(
        "country", "disaster_type_a", "start_date_a", "event_name_a", "records_a",
        "disaster_type_b", "start_date_b", "event_name_b", "records_b",
        gap.cast("int").alias("days_between"),
    )


def correlated_days(disasters: DataFrame, days: int = params.CORRELATION_DAYS) -> DataFrame:
    """``correlations`` of the days on which a type struck a country, whatever the number and names of its disasters."""
    return correlations(disasters.withColumn("event_name", F.lit("")), days)


# Tie order of the anomaly label.
ANOMALY_METRICS = ("magnitude", "deaths", "affected")


def moments(disasters: DataFrame) -> DataFrame:
    """(disaster_type, metric, n, mean, m2): number, mean and squared deviations from it of the known finite values."""
    of = {m: finite(F.col(m).cast("double")) for m in ANOMALY_METRICS}
    sums = disasters.groupBy("disaster_type").agg(
        *[F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")).alias(m) for m, v in of.items()]
    )
    each = F.array(*[F.struct(F.lit(m).alias("metric"), f"{m}.n", f"{m}.mean", f"{m}.m2") for m in ANOMALY_METRICS])
    return sums.select("disaster_type", F.inline(each)).filter("n > 0")


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments of all rows from those of parts of them, such as loads, in any order and grouping."""
    keys = ["disaster_type", "metric"]
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("center"))
    off = F.col("mean") - F.col("center")
    m2 = F.sum(F.col("m2") + F.col("n") * off * off).alias("m2")
    return parts.join(whole, keys).groupBy(*keys).agg(F.max("all").alias("n"), F.max("center").alias("mean"), m2)


def statistics(moments: DataFrame) -> DataFrame:
    """Average and sample deviation of each metric as ``anomalies`` takes them, one row per disaster type."""
    own = lambda m, value: F.max(F.when(F.col("metric") == m, value))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return moments.groupBy("disaster_type").agg(
        *[own(m, F.col("mean")).alias(f"{m}_avg") for m in ANOMALY_METRICS], *[own(m, std).alias(f"{m}_std") for m in ANOMALY_METRICS]
    )


def anomalies(disasters: DataFrame, z: dict[str, float] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Disasters that exceed avg + z * stddev of their type in at least one metric.

    A missing metric never fires; the label names the metric with the largest z-score. The
    statistics have one row per disaster type; how they are joined is left to Spark's size estimates. With ``known``
    statistics, kept from load to load, the disasters are not scanned for them.
    """
    limits = {m: 3.0 for m in ANOMALY_METRICS} | (z or {})
    stats = known if known is not None else disasters.groupBy("disaster_type").agg(
        *[F.avg(finite(F.col(m).cast("double"))).alias(f"{m}_avg") for m in ANOMALY_METRICS],
        *[F.stddev_samp(finite(F.col(m).cast("double"))).alias(f"{m}_std") for m in ANOMALY_METRICS],
    )
    overs, scores = [], []
    for m in ANOMALY_METRICS:
        over = F.col(m) > F.col(f"{m}_avg") + F.lit(limits[m]) * F.col(f"{m}_std")
        overs.append(F.coalesce(over, F.lit(False)))
        scores.append(F.when(over, (F.col(m) - F.col(f"{m}_avg")) / F.nullif(F.col(f"{m}_std"), F.lit(0.0))))
    top = F.greatest(*scores)
    label = F.coalesce(*[F.when(s == top, F.lit(m)) for m, s in zip(ANOMALY_METRICS, scores)])
    odd = disasters.join(stats, "disaster_type").filter(overs[0] | overs[1] | overs[2])
    return evaluate_once(odd, label.alias("anomaly_type"), beside=disasters.columns)


def hotspots(
    disasters: DataFrame,
    ranks: int = params.HOTSPOT_RANKS,
    deaths_weight: float = 1.0,
    damage_weight: float = 0.001,
    disaster_type: str | None = None,
) -> DataFrame:
    """The regions of each disaster type with most occurrences, then most impact.

    The aggregate combines map-side and Spark limits every task to ``ranks`` rows per type
    before the shuffle of the ranking.
    """
    if disaster_type is not None:
        disasters = disasters.filter(F.col("disaster_type") == disaster_type)
    impact = exact_sum(F.col("deaths")) * F.lit(deaths_weight) + exact_sum(F.col("damage_kusd")) * F.lit(damage_weight)
    grouped = disasters.groupBy("disaster_type", "country", "region").agg(
        F.count("*").alias("num_occurrences"), impact.alias("total_impact_score")
    )
    order = Window.partitionBy("disaster_type").orderBy(
        F.desc("num_occurrences"), F.desc("total_impact_score"), "country", "region"
    )
    return grouped.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)


def vulnerability(disasters: DataFrame) -> DataFrame:
    """Per country: count, deaths, damage, average recovery and an index from 0 to 1.

    The index is the mean of the three min-max scaled measures. The extremes are a scalar
    subquery over the same per-country aggregate, so nothing is joined or windowed.
    """
    recovery = F.datediff("end_date", "start_date")
    measures = ["total_deaths", "total_damage", "avg_recovery_days"]
    country = disasters.groupBy("country").agg(
        F.count("*").alias("disaster_count"),
        F.sum("deaths").alias("total_deaths"),
        exact_sum(F.col("damage_kusd")).alias("total_damage"),
        (F.sum(recovery) / F.nullif(F.count(recovery), F.lit(0))).alias("avg_recovery_days"),
    )
    extremes = country.agg(
        F.struct(*[F.min(m).alias(f"{m}_min") for m in measures], *[F.max(m).alias(f"{m}_max") for m in measures]).alias("e")
    ).scalar()

    def scaled(m: str):
        low, high = F.col("extremes").getField(f"{m}_min"), F.col("extremes").getField(f"{m}_max")
        return F.coalesce((F.col(m) - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0))

    index = (scaled(measures[0]) + scaled(measures[1]) + scaled(measures[2])) / F.lit(3)
    return (
        country.withColumn("extremes", extremes)
        .withColumn("vulnerability_index", index)
        .withColumn("vulnerability_label", vulnerability_label(F.col("vulnerability_index")))
        .drop("extremes")
    )


def vulnerability_summary(countries: DataFrame, critical: float = 0.8) -> DataFrame:
    """Number of countries, average index, and how many are critical, over unfiltered rows."""
    return countries.agg(
        F.count("*").alias("total_countries"),
        F.coalesce(
            round_to(exact_sum(F.col("vulnerability_index")) / F.nullif(F.count("vulnerability_index"), F.lit(0)), 2),
            F.lit(0.0),
        ).alias("average_index"),
        F.count_if(F.col("vulnerability_index") >= critical).alias("critical_countries"),
    )

"""Filtered, sorted and paged lists of the historical views, with their display texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hazardlens.functions import texts
from hazardlens.operators.events import ALL, text_match


def sort_order(df: DataFrame, by: str, direction: str = "asc", fold_case: bool = True, ties=()) -> list[Column]:
    """Order by one column, NULL last in both directions, then by tie columns."""
    key = F.lower(by) if fold_case and isinstance(df.schema[by].dataType, StringType) else F.col(by)
    return [key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(), *[F.col(t) for t in ties]]


def page(df: DataFrame, order, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the position texts "from", "to" and "total" on every row.

    The page itself is a distributed top-k; the total is a scalar subquery.
    """
    skip = (number - 1) * size
    total = df.agg(F.count("*").alias("total")).scalar()
    return (
        df.orderBy(*order).offset(skip).limit(size)
        .withColumns(
            {
                "total_results": total,
                "from_row": F.lit(skip + 1).cast("bigint"),
                "to_row": F.least(F.lit(skip + size).cast("bigint"), total),
            }
        )
    )


def page_after(df: DataFrame, by: Sequence[tuple[str, bool]], last: Mapping[str, Column], size: int) -> DataFrame:
    """The ``size`` rows behind the row ``last`` in the order ``by`` of (column, descending), NULL last.

    However deep the page, only rows behind ``last`` are ordered and each task keeps ``size`` of them; ``by`` has to
    make the order total and ``last`` to hold a value, NULL not included, for each of its columns.
    """
    behind, same = F.lit(False), F.lit(True)
    for name, descending in by:
        here = F.col(name).isNull() | ((F.col(name) < last[name]) if descending else (F.col(name) > last[name]))
        behind = behind | (same & here)
        same = same & (F.col(name) == last[name])
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in by]
    return df.filter(behind).orderBy(*order).limit(size)


def anomaly_list(
    anomalies: DataFrame,
    disaster_type: str = ALL,
    anomaly_type: str = ALL,
    years: tuple[int, int] | None = None,
    by: str | None = None,
    direction: str = "asc",
) -> DataFrame:
    out = anomalies if years is None else anomalies.filter(F.year("start_date").between(*years))
    if disaster_type != ALL:
        out = out.filter(F.lower("disaster_type") == disaster_type.lower())
    if anomaly_type != ALL:
        out = out.filter(F.col("anomaly_type") == anomaly_type)
    out = out.withColumns(
        {
            "magnitude_text": texts.decimal_text(F.col("magnitude")),
            "deaths_text": texts.count_text(F.col("deaths")),
            "affected_text": texts.count_text(F.col("affected")),
        }
    )
    return out.orderBy(*sort_order(out, by, direction, ties=("id",))) if by else out


def correlation_list(
    pairs: DataFrame,
    country: str = ALL,
    disaster_type: str = ALL,
    days_between: int | None = None,
    query: str = "",
    by: str | None = None,
    direction: str = "asc",
) -> DataFrame:
    out = pairs
    if country != ALL:
        out = out.filter(F.col("country") == country)
    if disaster_type != ALL:
        out = out.filter((F.col("disaster_type_a") == disaster_type) | (F.col("disaster_type_b") == disaster_type))
    if days_between is not None:
        out = out.filter(F.col("days_between") == days_between)
    if query:
        out = out.filter(text_match(query, "country", "event_name_a", "event_name_b"))
    out = out.withColumn("days_text", texts.days_text(F.col("days_between")))
    ties = ("country", "start_date_a", "event_name_a", "start_date_b", "event_name_b")
    return out.orderBy(*sort_order(out, by, direction, fold_case=False, ties=ties)) if by else out


def hotspot_list(ranked: DataFrame, disaster_type: str, by: str = "rank", direction: str = "asc") -> DataFrame:
    """One type's ranking; Catalyst pushes the type below the ranking window."""
    out = ranked.filter(F.col("disaster_type") == disaster_type)
    return out.orderBy(*sort_order(out, by, direction, ties=("rank",)))


def vulnerability_list(
    countries: DataFrame, query: str = "", by: str = "vulnerability_index", direction: str = "desc"
) -> DataFrame:
    out = countries.filter(text_match(query, "country")) if query else countries
    return out.orderBy(*sort_order(out, by, direction, fold_case=False, ties=("country",)))


def correlation_choices(pairs: DataFrame) -> DataFrame:
    """Distinct countries and distinct types of either side, for the filter menus; ``correlated_days`` is enough.

    Both lists come from one pass: each pair is spread to its three choices and the distinct
    combines map-side.
    """
    choice = F.inline(
        F.array(
            F.struct(F.lit("country").alias("choice"), F.col("country").alias("value")),
            F.struct(F.lit("disaster_type").alias("choice"), F.col("disaster_type_a").alias("value")),
            F.struct(F.lit("disaster_type").alias("choice"), F.col("disaster_type_b").alias("value")),
        )
    )
    return pairs.select(choice).distinct()

"""Rounding and order-independent sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding by scaling, the same on every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def finite(value: Column) -> Column:
    """The value, NULL where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def exact_sum(value: Column) -> Column:
    """Sum of the finite values; NULL without any.

    Values below 1e16 are summed as decimals rounded to 12 places, so their sum does not depend on task order. Larger
    ones do not fit a decimal and are added as doubles.
    """
    own = finite(value.cast("double"))
    small = own.try_cast("decimal(28,12)")
    decimals, rest = F.sum(small).cast("double"), F.sum(F.when(small.isNull(), own))
    return F.when(decimals.isNull(), rest).otherwise(decimals + F.coalesce(rest, F.lit(0.0)))


def exact_avg(value: Column) -> Column:
    """Average of the values that ``exact_sum`` adds; NULL without any."""
    return exact_sum(value) / F.nullif(F.count(finite(value.cast("double"))), F.lit(0)).cast("double")


def prepared(rows: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """Columns ``keep`` and, for each named value, what ``sum_of`` and ``avg_of`` add: tested and cast once for each row."""
    own = rows.select(*keep, *[finite(v.cast("double")).alias(f"{n}_own") for n, v in values.items()])
    small = own.select("*", *[F.col(f"{n}_own").try_cast("decimal(28,12)").alias(f"{n}_small") for n in values])
    return small.select("*", *[F.when(F.col(f"{n}_small").isNull(), F.col(f"{n}_own")).alias(f"{n}_rest") for n in values])


def sum_of(name: str) -> Column:
    """``exact_sum`` of a prepared value."""
    decimals, rest = F.sum(f"{name}_small").cast("double"), F.sum(f"{name}_rest")
    return F.when(decimals.isNull(), rest).otherwise(decimals + F.coalesce(rest, F.lit(0.0)))


def avg_of(name: str) -> Column:
    """``exact_avg`` of a prepared value."""
    return sum_of(name) / F.nullif(F.count(f"{name}_own"), F.lit(0)).cast("double")

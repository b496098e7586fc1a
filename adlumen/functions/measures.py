"""Ratios on exact decimals. Spark's ANSI mode raises on division by zero, so
every divisor goes through ``nullif``: an empty divisor gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """A count as a decimal, so that division stays exact."""
    return value.cast("decimal(20,0)")


def ratio(part: Column, base: Column, digits: int) -> Column:
    """``part / base`` rounded half up; NULL when the base is zero."""
    return F.round(part / F.nullif(base, F.lit(0)), digits)


def percent(part: Column, base: Column) -> Column:
    """Share of one count in another, in percent with two digits."""
    return ratio(whole(part) * 100, whole(base), 2)


def growth(now: Column, before: Column) -> Column:
    """Change against an earlier count, in percent with two digits."""
    return ratio((whole(now) - whole(before)) * 100, whole(before), 2)


def mean_cost(total: Column, count: Column) -> Column:
    """Mean of a DECIMAL(10,4) cost with eight digits, from its sum and its count.

    The reports show the sum anyway; AVG would carry a second one through every shuffle.
    """
    return (total / F.nullif(whole(count), F.lit(0))).cast("decimal(14,8)")


def frequency(count: Column, users: Column) -> Column:
    """Impressions per user with four digits."""
    return ratio(whole(count), whole(users), 4)


def or_zero(value: Column) -> Column:
    """0 where there is nothing to report."""
    return F.coalesce(value, F.lit(0))

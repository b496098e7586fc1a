"""Tenant and time filters, written so that they reach the file scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Moment = datetime | None


def scope(df: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Rows of one tenant, or all rows when no tenant is named."""
    return df if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)


def tenant_keys(tenant_id: int | None) -> list[str]:
    """Grouping columns that keep tenants apart."""
    return ["tenant_id"] if tenant_id is None else []


def listed(figures: DataFrame, tenants: DataFrame | None, tenant_id: int | None) -> DataFrame:
    """``figures`` per tenant with a row of zeros for each of ``tenants`` that has none.

    One tenant alone always has its row, so ``tenants`` (a ``tenant_id`` column)
    only matters when all are asked for. Both sides have a row or a few per
    tenant: they are put together and merged by one small exchange.
    """
    if tenants is None or tenant_id is not None:
        return figures
    known = tenants.select("tenant_id", F.lit(True).alias("_listed"))
    both = figures.unionByName(known, allowMissingColumns=True).groupBy("tenant_id").agg(
        F.max("_listed").alias("_listed"),
        *[F.max(name).alias(name) for name in figures.columns if name != "tenant_id"])
    return both.filter("_listed").select(*figures.columns).fillna(0)


def by_date(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Time bounds repeated on ``date``, where the table has it, so that folders are pruned."""
    if "date" not in df.columns:
        return df
    if start is not None:
        df = df.filter(F.col("date") >= F.to_date(start))
    return df if end is None else df.filter(F.col("date") <= F.to_date(end))


def moment(df: DataFrame, as_of: Moment = None, column: str = "timestamp") -> Column:
    """``as_of`` in the type of ``column``; the current time when it is None.

    The literal takes the column's own type: a cast on the column side would
    keep the comparison out of the Parquet filters. Naive times are UTC.
    """
    plain = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    if as_of is None:
        return F.localtimestamp() if plain else F.current_timestamp()
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    text = as_of.isoformat(sep=" ", timespec="microseconds")
    return F.expr(f"TIMESTAMP_NTZ '{text}'" if plain else f"TIMESTAMP_LTZ '{text} UTC'")


def span(**parts: int) -> Column:
    """Interval literal, such as ``span(hours=1)``."""
    whole = timedelta(**parts)
    return F.expr(f"INTERVAL '{whole.days} {whole.seconds // 3600}:"
                  f"{whole.seconds // 60 % 60}:{whole.seconds % 60}' DAY TO SECOND")


def trailing(df: DataFrame, as_of: Moment = None, column: str = "timestamp", *,
             closed: bool = True, **parts: int) -> DataFrame:
    """Rows from ``as_of`` minus the given span on; ``closed`` also ends at ``as_of``.

    On a table partitioned by ``date`` the bounds are repeated on that column,
    since a filter on the timestamp alone prunes no partitions.
    """
    end = moment(df, as_of, column)
    start = end - span(**parts)
    kept = df.filter(F.col(column) >= start)
    if closed:
        kept = kept.filter(F.col(column) <= end)
    return kept if column == "date" else by_date(kept, start, end if closed else None)


def on_day(df: DataFrame, day: date | None = None, column: str = "timestamp") -> DataFrame:
    """Rows of one calendar day as a half-open range."""
    if day is None:
        today = F.date_trunc("day", moment(df, None, column))
        start = today.cast(df.schema[column].dataType)
    else:
        start = moment(df, datetime(day.year, day.month, day.day), column)
    kept = df.filter((F.col(column) >= start) & (F.col(column) < start + span(days=1)))
    if column != "date" and "date" in df.columns:
        kept = kept.filter(F.col("date") == F.to_date(start))
    return kept


def day_column(day: date | None = None) -> Column:
    """The day itself as a DATE value."""
    return F.current_date() if day is None else F.lit(day.isoformat()).cast("date")


def date_range_filter(df: DataFrame, tenant_id: int | None = None, start: Moment = None,
                      end: Moment = None, column: str = "timestamp") -> DataFrame:
    """Tenant and inclusive time range; whatever is not given does not filter."""
    kept = scope(df, tenant_id)
    first = None if start is None else moment(df, start, column)
    last = None if end is None else moment(df, end, column)
    if first is not None:
        kept = kept.filter(F.col(column) >= first)
    if last is not None:
        kept = kept.filter(F.col(column) <= last)
    return by_date(kept, first, last)

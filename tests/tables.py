"""Small in-memory tables with the declared types."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

NOW = datetime(2024, 3, 1, 12)


def at(text: str) -> datetime:
    """'03-01 12:00' in 2024."""
    return datetime.strptime(f"2024-{text}", "%Y-%m-%d %H:%M")


def day(text: str) -> date:
    return datetime.strptime(f"2024-{text}", "%Y-%m-%d").date()


def impressions(spark, rows):
    """(id, tenant, ad, user, time, cost)"""
    typed = [(i, t, a, u, at(when), None if c is None else Decimal(c))
             for i, t, a, u, when, c in rows]
    return spark.createDataFrame(
        typed, "id bigint, tenant_id int, ad_id bigint, user_id bigint, timestamp timestamp_ntz, "
               "cost decimal(10,4)")


def campaigns(spark, rows):
    """(id, tenant, name, budget, status, start)"""
    typed = [(i, t, n, Decimal(b), s, day(d), date(2024, 12, 31)) for i, t, n, b, s, d in rows]
    return spark.createDataFrame(
        typed, "id bigint, tenant_id int, name string, budget decimal(12,2), status string, "
               "start_date date, end_date date")


def ads(spark, rows):
    """(id, tenant, campaign)"""
    return spark.createDataFrame(rows, "id bigint, tenant_id int, campaign_id bigint")


def clicks(spark, rows):
    """(id, tenant, impression, time)"""
    return spark.createDataFrame(
        [(i, t, m, at(when)) for i, t, m, when in rows],
        "id bigint, tenant_id int, impression_id bigint, timestamp timestamp_ntz")


def conversions(spark, rows):
    """(id, tenant, click, value, time)"""
    return spark.createDataFrame(
        [(i, t, c, Decimal(v), at(when)) for i, t, c, v, when in rows],
        "id bigint, tenant_id int, click_id bigint, conversion_value decimal(10,2), "
        "timestamp timestamp_ntz")


def log(spark, rows):
    """(id, tenant, type, aggregate, payload, time, sequence)"""
    return spark.createDataFrame(
        [(i, t, k, a, p, at(when), n) for i, t, k, a, p, when, n in rows],
        "id bigint, tenant_id int, event_type string, aggregate_id string, payload string, "
        "timestamp timestamp_ntz, sequence_number bigint")


def rows_of(df, *columns):
    """Rows as plain tuples; decimals as floats so that expectations read well."""
    chosen = df.select(*columns) if columns else df
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in row)
            for row in chosen.collect()]

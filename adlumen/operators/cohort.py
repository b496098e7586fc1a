"""Retention of users by the day they were first seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.measures import percent, ratio, whole
from adlumen.functions.scope import Moment, by_date, moment, scope, span, tenant_keys
from adlumen.functions.sizing import BROADCAST_ROWS
from adlumen.session import settle

# Rows of the history that one task adds up by user.
ROWS_A_TASK = 1_000_000


def _cohort_periods(rows: DataFrame, tenant_id: int | None, horizon_days: int,
                    opens: Column | None = None) -> DataFrame:
    """One row per cohort day and days since it, with users, impressions, spend.

    A user's cohort is the first day with a row that ``opens`` one; by default
    any row does. The facts are first reduced to one row per user and day, which Spark does
    map-side: a user with very many impressions costs no more than the days on
    which it was seen. Each such row is one user in one period, so counting
    users needs no DISTINCT, and the cohort day is a window over those few
    rows instead of a second scan of the facts.
    """
    measures = [F.count("*").alias("impressions"), F.sum("cost").alias("spend")]
    if opens is not None:
        measures.append(F.max(opens).alias("opens"))
    user_days = rows.filter(F.col("user_id").isNotNull()).groupBy(
        *tenant_keys(tenant_id), "user_id", F.to_date("timestamp").alias("day")
    ).agg(*measures)
    return _periods_of_days(user_days, tenant_keys(tenant_id), horizon_days, opens is not None)


def _periods_of_days(user_days: DataFrame, by: list[str], horizon_days: int,
                     marked: bool = False) -> DataFrame:
    """The same from user days (user_id, day, impressions, spend and, if ``marked``, opens)."""
    opening_day = F.when(F.col("opens"), F.col("day")) if marked else F.col("day")
    first_day = F.min(opening_day).over(Window.partitionBy(*by, "user_id"))
    placed = user_days.withColumn("cohort_month", first_day).withColumn(
        "period_days", F.datediff("day", "cohort_month")
    )
    # A user who never opens a cohort has a NULL period and falls out here.
    return (
        placed.filter(F.col("period_days") <= horizon_days)
        .groupBy(*by, "cohort_month", "period_days")
        .agg(
            F.count("*").alias("users"),
            F.sum("impressions").alias("total_impressions"),
            F.sum("spend").alias("cohort_spend"),
        )
    )


def _cohort_size(tenant_id: int | None) -> Column:
    """Users in the cohort's first listed period."""
    along = Window.partitionBy(*tenant_keys(tenant_id), "cohort_month").orderBy("period_days")
    return F.first_value("users").over(along)


def cohort_retention(impressions: DataFrame, tenant_id: int | None = None,
                     horizon_days: int = 30) -> DataFrame:
    """Users and impressions per first-seen day and days since then.

    ``cohort_month`` is a day; the name is the established one.
    """
    periods = _cohort_periods(scope(impressions, tenant_id), tenant_id, horizon_days)
    return _retention(periods, tenant_id)


def retention_of_days(user_days: DataFrame, horizon_days: int = 30) -> DataFrame:
    """``cohort_retention`` of one tenant from its user days (user_id, day, impressions, spend)."""
    return _retention(_periods_of_days(user_days, [], horizon_days), tenant_id=0)


def _retention(periods: DataFrame, tenant_id: int | None) -> DataFrame:
    by = tenant_keys(tenant_id)
    rate = percent(F.col("users"), _cohort_size(tenant_id))
    return periods.select(
        *by, "cohort_month", "period_days", "users", "total_impressions",
        rate.alias("retention_rate"),
    ).orderBy(*by, "cohort_month", "period_days")


def _of_openers(rows: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """Rows of the users with a row since the cutoff, as far as that is worth a join.

    Those users are written once and counted. Few are sent to where the history is
    read. For many it is laid out by user as the sums need it, in parts of so many
    rows, more of them the longer it is, and who opens no cohort falls out of the
    sums: what a task adds up does not grow with the table.
    """
    keys = [*by, "user_id"]
    known = [F.col(key).isNotNull() for key in keys]
    recent = by_date(rows.filter(F.col("timestamp") >= cutoff), cutoff)
    users = settle(recent.filter(F.col("user_id").isNotNull()).select(*keys).distinct())
    if users.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(users), keys, "left_semi")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.filter(reduce(Column.__and__, known)).repartition(parts, *keys)


def advanced_cohort(impressions: DataFrame, tenant_id: int | None = None, days_back: int = 30,
                    as_of: Moment = None, horizon_days: int = 30,
                    non_negative: bool = False) -> DataFrame:
    """Retention of users first seen in the last ``days_back`` days, with spend.

    Earlier activity of the same users is kept and shows as negative periods;
    ``non_negative`` leaves it out and then also skips reading it.
    Works on the impression table and on its warehouse copy alike.

    Who opens a cohort is found first, from the recent days alone, and of the
    history only those users' rows are kept: where it is read, while the openers
    are few enough to be sent along. Beyond that the history is laid out by
    user, as the sums that follow need it, so it is shuffled no more than once.
    """
    by = tenant_keys(tenant_id)
    until = moment(impressions, as_of)
    cutoff = until - span(days=days_back)
    rows = scope(impressions, tenant_id).filter(F.col("timestamp") <= until)
    if non_negative:
        kind = impressions.schema["timestamp"].dataType
        rows = rows.filter(F.col("timestamp") >= F.date_trunc("day", cutoff).cast(kind))
        if "date" in rows.columns:
            rows = rows.filter(F.col("date") >= F.to_date(cutoff))
    else:
        rows = _of_openers(rows, by, cutoff)
    periods = _cohort_periods(rows, tenant_id, horizon_days, F.col("timestamp") >= cutoff)
    if non_negative:
        periods = periods.filter(F.col("period_days") >= 0)
    sized = periods.withColumnRenamed("users", "active_users").withColumn(
        "cohort_size",
        F.first_value("active_users").over(
            Window.partitionBy(*by, "cohort_month").orderBy("period_days")
        ),
    )
    return sized.select(
        *by, "cohort_month", "period_days", "active_users", "total_impressions",
        "cohort_spend", "cohort_size",
        percent(F.col("active_users"), F.col("cohort_size")).alias("retention_rate"),
        ratio(F.col("cohort_spend"), whole(F.col("active_users")), 4).alias("revenue_per_user"),
    ).orderBy(*by, "cohort_month", "period_days")

"""Trailing-window and single-day figures for dashboards and bidding."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlumen.functions.measures import frequency, mean_cost, or_zero
from adlumen.functions.scope import (
    Moment, day_column, listed, on_day, scope, tenant_keys, trailing,
)
from adlumen.operators.placement import ads_of_campaigns, under_campaigns, with_campaign

# Bid formula.
DEFAULT_BID, BUSY_FACTOR, QUIET_FACTOR = "0.5", "1.1", "0.9"
BUSY_VOLUME, CONFIDENT_VOLUME = 100, 50


def _trailing_measures(spend: str) -> list[Column]:
    users = F.countDistinct("user_id")
    return [
        F.count("*").alias("impressions_last_hour"),
        users.alias("unique_users"),
        or_zero(F.sum("cost")).alias(spend),
        or_zero(mean_cost(F.sum("cost"), F.count("cost"))).alias("avg_cpm"),
        or_zero(frequency(F.count("*"), users)).alias("frequency"),
    ]


def _recent(impressions: DataFrame, ads: DataFrame, tenant_id: int | None,
            campaign_id: int | None, as_of: Moment, hours: int) -> DataFrame:
    if campaign_id is not None:
        ads = ads.filter(F.col("campaign_id") == campaign_id)
    recent = trailing(scope(impressions, tenant_id), as_of, hours=hours)
    return with_campaign(recent, ads, "user_id", "cost")


def realtime_metrics(impressions: DataFrame, ads: DataFrame, tenant_id: int | None = None,
                     campaign_id: int | None = None, as_of: Moment = None,
                     hours: int = 1, tenants: DataFrame | None = None) -> DataFrame:
    """Volume, reach, spend and frequency of the trailing hour; zeros if it is empty.

    Here and below, ``tenants`` (a ``tenant_id`` column) lists also the idle ones.
    """
    rows = _recent(impressions, ads, tenant_id, campaign_id, as_of, hours)
    figures = rows.groupBy(*tenant_keys(tenant_id)).agg(*_trailing_measures("spend_last_hour"))
    return listed(figures, tenants, tenant_id)


def campaign_live_metrics(impressions: DataFrame, ads: DataFrame, tenant_id: int | None = None,
                          campaign_id: int | None = None, as_of: Moment = None,
                          hours: int = 1, campaigns: DataFrame | None = None) -> DataFrame:
    """The same for one campaign, with status active or idle.

    Without a campaign, one row for each; pass ``campaigns`` to list the idle ones too.
    """
    by = tenant_keys(tenant_id) if campaign_id is not None else ["tenant_id", "campaign_id"]
    rows = _recent(impressions, ads, tenant_id, campaign_id, as_of, hours)
    live = rows.groupBy(*by).agg(*_trailing_measures("total_spend"))
    if campaigns is not None and campaign_id is None:
        known = scope(campaigns, tenant_id).select("tenant_id", F.col("id").alias("campaign_id"))
        live = known.join(live, ["tenant_id", "campaign_id"], "left").fillna(0)
    status = F.when(F.col("impressions_last_hour") > 0, "active").otherwise("idle")
    live = live.withColumn("status", status)
    return live.drop("tenant_id") if tenant_id is not None else live


def active_campaign_count(campaigns: DataFrame, tenant_id: int | None = None,
                          tenants: DataFrame | None = None) -> DataFrame:
    """Campaigns with status active."""
    active = scope(campaigns, tenant_id).filter(F.col("status") == "active")
    figures = active.groupBy(*tenant_keys(tenant_id)).agg(
        F.count("*").alias("active_campaigns"))
    return listed(figures, tenants, tenant_id)


def impressions_on_day(impressions: DataFrame, tenant_id: int | None = None,
                       day: date | None = None, tenants: DataFrame | None = None) -> DataFrame:
    """Impressions of a day, today by default."""
    rows = on_day(scope(impressions, tenant_id), day)
    figures = rows.groupBy(*tenant_keys(tenant_id)).agg(F.count("*").alias("impressions"))
    return listed(figures, tenants, tenant_id)


def unique_users_on_day(impressions: DataFrame, tenant_id: int | None = None,
                        day: date | None = None, approximate: bool = False,
                        tenants: DataFrame | None = None) -> DataFrame:
    """Distinct users of a day; ``approximate`` trades exactness for one small sketch."""
    rows = on_day(scope(impressions, tenant_id), day)
    users = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    figures = rows.groupBy(*tenant_keys(tenant_id)).agg(users.alias("unique_users"))
    return listed(figures, tenants, tenant_id)


# Registers of a sketch as a power of two: a relative error of some 0.8 per cent.
SKETCH_SIZE = 14


def user_sketches(impressions: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Per tenant and day, impressions and a sketch of the users, to be stored and merged.

    A sketch is some kilobytes whatever the day holds. Today's can be merged
    with one of rows that arrive later, and days add up to weeks, which distinct
    counts do not.
    """
    rows = scope(impressions, tenant_id)
    return rows.groupBy(*tenant_keys(tenant_id), F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("impressions"),
        F.hll_sketch_agg("user_id", F.lit(SKETCH_SIZE)).alias("users"))


def merged_users(sketches: DataFrame, by: list[str], first: date | None = None,
                 last: date | None = None) -> DataFrame:
    """Impressions and estimated users over the days of ``user_sketches`` from ``first`` to ``last``."""
    days = sketches
    if first is not None:
        days = days.filter(F.col("date") >= day_column(first))
    if last is not None:
        days = days.filter(F.col("date") <= day_column(last))
    return days.groupBy(*by).agg(
        F.sum("impressions").alias("impressions"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"))


def spend_last_hour(impressions: DataFrame, tenant_id: int | None = None, as_of: Moment = None,
                    hours: int = 1, tenants: DataFrame | None = None) -> DataFrame:
    """Cost of the trailing hour, 0 if there is none."""
    rows = trailing(scope(impressions, tenant_id), as_of, hours=hours)
    figures = rows.groupBy(*tenant_keys(tenant_id)).agg(or_zero(F.sum("cost")).alias("spend"))
    return listed(figures, tenants, tenant_id)


def campaign_day_totals(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                        tenant_id: int | None = None, day: date | None = None,
                        same_tenant_ads: bool = True) -> DataFrame:
    """Every campaign with its impressions and spend of a day, zeros included.

    The day's facts are reduced per ad first; after that only dimension-sized
    tables are joined.
    """
    per_ad = on_day(scope(impressions, tenant_id), day).groupBy("tenant_id", "ad_id").agg(
        F.count("*").alias("shown"), F.sum("cost").alias("cost")
    )
    owned = scope(campaigns, tenant_id)
    lookup = ads_of_campaigns(owned, scope(ads, tenant_id) if same_tenant_ads else ads)
    per_campaign = per_ad.join(lookup, ["ad_id", "tenant_id"]).groupBy(
        "tenant_id", "campaign_id"
    ).agg(F.sum("shown").alias("impressions"), F.sum("cost").alias("spend"))
    listed = owned.select("tenant_id", F.col("id").alias("campaign_id"), "name")
    return listed.join(per_campaign, ["tenant_id", "campaign_id"], "left").select(
        "tenant_id", "campaign_id", "name",
        or_zero(F.col("impressions")).alias("impressions"),
        or_zero(F.col("spend")).alias("spend"),
    )


def top_campaign_on_day(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                        tenant_id: int | None = None, day: date | None = None) -> DataFrame:
    """The campaign with most impressions of a day; the lowest id among equals."""
    totals = campaign_day_totals(campaigns, ads, impressions, tenant_id, day,
                                 same_tenant_ads=False)
    best = totals.groupBy(*tenant_keys(tenant_id)).agg(
        F.max_by(F.struct("campaign_id", "name", "impressions"),
                 F.struct("impressions", -F.col("campaign_id"))).alias("top")
    )
    chosen = best.select(
        *tenant_keys(tenant_id), F.col("top.campaign_id").alias("id"),
        F.col("top.name").alias("name"), F.col("top.impressions").alias("impressions"),
        F.lit(1).alias("impression_rank"),
    )
    return chosen.filter(F.col("id").isNotNull())


def dashboard_totals(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                     tenant_id: int | None = None, day: date | None = None,
                     tenants: DataFrame | None = None) -> DataFrame:
    """Active campaigns, and impressions, spend and users of a day under them."""
    by = tenant_keys(tenant_id)
    active = scope(campaigns, tenant_id).filter(F.col("status") == "active")
    facts = under_campaigns(active, scope(ads, tenant_id), on_day(scope(impressions, tenant_id), day),
                            "user_id", "cost", same_tenant=True)
    shown = facts.groupBy("tenant_id").agg(
        F.count("*").alias("impressions"),
        F.sum("cost").alias("spend"),
        F.countDistinct("user_id").alias("users"),
    )
    # One row per active campaign plus one per tenant, added up: no join needed.
    parts = active.select("tenant_id", F.lit(1).alias("campaigns")).unionByName(
        shown, allowMissingColumns=True
    )
    figures = parts.groupBy(*by).agg(
        F.count("campaigns").alias("active_campaigns"),
        or_zero(F.sum("impressions")).alias("impressions_today"),
        or_zero(F.sum("spend")).alias("spend_today"),
        or_zero(F.sum("users")).alias("unique_users_today"),
    )
    return listed(figures, tenants, tenant_id)


def bid_price(impressions: DataFrame, tenant_id: int | None = None, as_of: Moment = None,
              minutes: int = 15, tenants: DataFrame | None = None) -> DataFrame:
    """Bid from the mean cost of the trailing minutes, one row per tenant.

    Pass ``tenants`` (a ``tenant_id`` column) to price also those without recent traffic.
    """
    rows = trailing(scope(impressions, tenant_id), as_of, minutes=minutes)
    recent = rows.groupBy(*tenant_keys(tenant_id)).agg(
        F.avg("cost").alias("mean"), F.count("*").alias("volume")
    )
    if tenant_id is not None:
        recent = recent.select(F.lit(tenant_id).cast("int").alias("tenant_id"), "mean", "volume")
    elif tenants is not None:
        recent = tenants.select("tenant_id").distinct().join(recent, "tenant_id", "left")
    volume = or_zero(F.col("volume"))
    mean = F.coalesce(F.nullif(F.col("mean"), F.lit(0)), F.lit(DEFAULT_BID).cast("decimal(14,8)"))
    factor = F.when(volume > BUSY_VOLUME, F.lit(BUSY_FACTOR).cast("decimal(2,1)")).otherwise(
        F.lit(QUIET_FACTOR).cast("decimal(2,1)")
    )
    return recent.select(
        "tenant_id",
        F.round(mean * factor, 4).alias("bid_price"),
        F.when(volume > CONFIDENT_VOLUME, "high").otherwise("medium").alias("confidence"),
    )


def tenant_totals(impressions: DataFrame, log: DataFrame,
                  tenant_id: int | None = None) -> DataFrame:
    """Log events, impression events and stored impressions per tenant."""
    by = tenant_keys(tenant_id)
    events = scope(log, tenant_id).groupBy("tenant_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "impression_created").alias("impression_events"),
    )
    stored = scope(impressions, tenant_id).groupBy("tenant_id").agg(F.count("*").alias("stored"))
    return events.unionByName(stored, allowMissingColumns=True).groupBy(*by).agg(
        or_zero(F.sum("events")).alias("total_events"),
        or_zero(F.sum("impression_events")).alias("total_impression_events"),
        or_zero(F.sum("stored")).alias("total_impressions"),
    )

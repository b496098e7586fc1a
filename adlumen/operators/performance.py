"""Campaign performance: by day, by hour, in total, ranked."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.measures import frequency, growth, mean_cost, ratio, whole
from adlumen.functions.scope import Moment, moment, scope, tenant_keys, trailing
from adlumen.functions.sizing import lookup_side
from adlumen.operators.placement import under_campaigns, with_campaign
from adlumen.session import settle


def _names(campaigns: DataFrame, *more: str) -> DataFrame:
    """Campaign attributes, joined after aggregation so they never travel with facts."""
    return campaigns.select(
        F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"), *more
    )


def _volume() -> list[Column]:
    """Impressions, users and cost of a group.

    Spark computes the distinct users by first grouping on (key, user), so a
    hot campaign is spread over its users and merged map-side.
    """
    return [
        F.count("*").alias("impressions"),
        F.countDistinct("user_id").alias("unique_users"),
        F.sum("cost").alias("total_cost"),
        mean_cost(F.sum("cost"), F.count("cost")).alias("avg_cost"),
    ]


def _top(df: DataFrame, by: list[str], limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows along ``order``, per tenant when tenants are listed together."""
    if not by:
        return df.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        df.withColumn("_place", place).filter(F.col("_place") <= limit)
        .orderBy(*by, "_place").drop("_place")
    )


def campaign_daily_performance(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                               tenant_id: int | None = None,
                               own_impressions: bool = True) -> DataFrame:
    """Each campaign's days with volume, rank of the day and growth over the
    previous listed day.

    For one tenant only its own impressions are read; pass
    ``own_impressions=False`` if others may have recorded some on its campaigns.
    """
    by = tenant_keys(tenant_id)
    owned = scope(campaigns, tenant_id)
    shown = scope(impressions, tenant_id) if own_impressions else impressions
    facts = under_campaigns(owned, ads, shown, "user_id", "timestamp", "cost")
    days = facts.groupBy("tenant_id", "campaign_id", F.to_date("timestamp").alias("date")).agg(
        *_volume()
    )
    return _with_growth(days, owned, ["tenant_id"], by)


def daily_of_campaigns(days: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``campaign_daily_performance`` of one tenant from its campaign days and campaigns."""
    return _with_growth(days, campaigns, [], [])


def _with_growth(days: DataFrame, owned: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    # Windows over campaign days: at most one row per day and campaign.
    campaign = Window.partitionBy(*keys, "campaign_id")
    busiest = campaign.orderBy(F.desc("impressions"), "date")
    days = days.withColumn("daily_rank", F.row_number().over(busiest)).withColumn(
        "prev_day_impressions", F.lag("impressions").over(campaign.orderBy("date"))
    )
    return days.join(_names(owned), "campaign_id").select(
        *by, "campaign_id", "campaign_name", "date", "impressions", "total_cost", "avg_cost",
        "unique_users", "daily_rank", "prev_day_impressions",
        growth(F.col("impressions"), F.col("prev_day_impressions")).alias("growth_rate"),
    ).orderBy(*by, "campaign_id", F.desc("date"))


def top_campaigns(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                  tenant_id: int | None = None, limit: int = 10,
                  own_impressions: bool = True) -> DataFrame:
    """Campaigns with most impressions, ranked by volume and by cost per impression.

    ``own_impressions`` as in ``campaign_daily_performance``.

    ``avg_cpm`` is the cost of a single impression; the name is the established one.
    """
    by = tenant_keys(tenant_id)
    owned = scope(campaigns, tenant_id)
    shown = scope(impressions, tenant_id) if own_impressions else impressions
    facts = under_campaigns(owned, ads, shown, "user_id", "cost")
    totals = facts.groupBy("tenant_id", "campaign_id").agg(
        F.count("*").alias("total_impressions"),
        F.sum("cost").alias("total_spend"),
        F.countDistinct("user_id").alias("unique_users"),
    )
    return _ranked(totals, owned, ["tenant_id"], by, limit)


def ranked_campaigns(totals: DataFrame, campaigns: DataFrame, limit: int) -> DataFrame:
    """``top_campaigns`` of one tenant from totals per campaign and the tenant's campaigns."""
    owned = totals.join(lookup_side(campaigns.select(F.col("id").alias("campaign_id"))),
                        "campaign_id", "left_semi")
    return _ranked(owned, campaigns, [], [], limit)


def _ranked(totals: DataFrame, owned: DataFrame, keys: list[str], by: list[str],
            limit: int) -> DataFrame:
    totals = totals.withColumn(
        "avg_cpm", ratio(F.col("total_spend"), whole(F.col("total_impressions")), 4)
    )
    # Ranked rows are campaigns, not facts.
    tenant = Window.partitionBy(*keys)
    ranked = totals.withColumn(
        "impression_rank", F.rank().over(tenant.orderBy(F.desc("total_impressions")))
    ).withColumn("efficiency_rank", F.rank().over(tenant.orderBy("avg_cpm")))
    named = ranked.join(_names(owned), "campaign_id").select(
        *by, F.col("campaign_id").alias("id"), F.col("campaign_name").alias("name"),
        "total_impressions", "total_spend", "unique_users", "avg_cpm", "impression_rank",
        "efficiency_rank",
    )
    return _top(named, by, limit, F.desc("total_impressions"), F.col("id"))


def campaign_ranking(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                     tenant_id: int | None = None, limit: int = 20,
                     as_of: Moment = None) -> DataFrame:
    """Active campaigns with impressions, by the mean of three ranks."""
    by = tenant_keys(tenant_id)
    active = scope(campaigns, tenant_id).filter(F.col("status") == "active")
    facts = under_campaigns(active, ads, scope(impressions, tenant_id), "user_id", "cost",
                            same_tenant=True)
    totals = facts.groupBy("tenant_id", "campaign_id").agg(
        F.count("*").alias("total_impressions"),
        F.countDistinct("user_id").alias("unique_users"),
        F.sum("cost").alias("total_spend"),
        mean_cost(F.sum("cost"), F.count("cost")).alias("avg_cpm"),
    )
    today = F.to_date(moment(impressions, as_of))
    scored = totals.join(_names(active, "budget", "start_date"), "campaign_id").select(
        "tenant_id", "campaign_id", "campaign_name", "budget", "total_impressions",
        "unique_users", "total_spend", "avg_cpm",
        frequency(F.col("total_impressions"), F.col("unique_users")).alias("frequency"),
        F.datediff(today, "start_date").alias("days_running"),
    )
    tenant = Window.partitionBy("tenant_id")
    ranked = scored.select(
        "*",
        ratio(F.col("total_spend") * 100, F.col("budget"), 2).alias("budget_utilization"),
        ratio(whole(F.col("total_impressions")), whole(F.col("days_running")), 0)
        .alias("daily_impression_rate"),
        F.row_number().over(tenant.orderBy(F.desc("total_impressions"), "campaign_id"))
        .alias("impression_rank"),
        F.row_number().over(tenant.orderBy("avg_cpm", "campaign_id")).alias("efficiency_rank"),
        F.row_number().over(tenant.orderBy(F.desc("unique_users"), "campaign_id"))
        .alias("reach_rank"),
    )
    ranks = F.col("impression_rank") + F.col("efficiency_rank") + F.col("reach_rank")
    scored = ranked.withColumn("overall_score", ratio(whole(ranks), whole(F.lit(3)), 1))
    if not by:
        scored = scored.drop("tenant_id")
    return _top(scored, by, limit, F.col("overall_score"), F.col("campaign_id"))


def hourly_trend(ads: DataFrame, impressions: DataFrame, tenant_id: int | None = None,
                 campaign_id: int | None = None, hours_back: int = 24,
                 as_of: Moment = None) -> DataFrame:
    """Hour buckets of the trailing hours with growth over the previous listed one.

    Without a campaign, every campaign's trend at once.
    """
    by = tenant_keys(tenant_id)
    of_campaign = ads
    if campaign_id is not None:
        of_campaign = ads.filter(F.col("campaign_id") == campaign_id)
    else:
        by = [*by, "campaign_id"]
    recent = trailing(scope(impressions, tenant_id), as_of, hours=hours_back)
    facts = with_campaign(recent, of_campaign, "user_id", "timestamp", "cost")
    bucket = F.date_format("timestamp", "yyyy-MM-dd HH:00:00").alias("hour_bucket")
    hours = facts.groupBy(*by, bucket).agg(
        F.count("*").alias("impressions"),
        F.countDistinct("user_id").alias("unique_users"),
        F.sum("cost").alias("spend"),
        mean_cost(F.sum("cost"), F.count("cost")).alias("avg_cost"),
    )
    # At most hours_back + 1 rows per campaign.
    before = F.lag("impressions").over(Window.partitionBy(*by).orderBy("hour_bucket"))
    hours = hours.withColumn("prev_hour_impressions", before)
    rate = F.when(F.col("prev_hour_impressions").isNull(), F.lit(0)).otherwise(
        growth(F.col("impressions"), F.col("prev_hour_impressions"))
    )
    return hours.withColumn("growth_rate", rate).orderBy(*by, F.desc("hour_bucket"))


def warehouse_daily_performance(facts: DataFrame, tenant_id: int | None = None,
                                campaign_id: int | None = None, days_back: int = 30,
                                as_of: Moment = None) -> DataFrame:
    """Daily performance over the warehouse copy, trailing days only.

    The copy carries the campaign, so no join; its ``date`` partitions are pruned.
    """
    by = tenant_keys(tenant_id)
    rows = trailing(scope(facts, tenant_id), as_of, days=days_back)
    if campaign_id is not None:
        rows = rows.filter(F.col("campaign_id") == campaign_id)
    day = F.col("date") if "date" in facts.columns else F.to_date("timestamp").alias("date")
    days = rows.groupBy(*by, "campaign_id", day).agg(*_volume())
    campaign = Window.partitionBy(*by, "campaign_id").orderBy("date")
    days = days.withColumn("prev_day_impressions", F.lag("impressions").over(campaign))
    rate = F.when(F.col("prev_day_impressions").isNull(), F.lit(0)).otherwise(
        growth(F.col("impressions"), F.col("prev_day_impressions"))
    )
    return days.withColumn("growth_rate", rate).orderBy(*by, "campaign_id", F.desc("date"))


def campaign_report(ads: DataFrame, impressions: DataFrame, tenant_id: int | None = None,
                    campaign_id: int | None = None, days: int = 30) -> DataFrame:
    """The latest active days of a campaign, newest first; of each when none is named.

    The days are found first, from the times alone; only the facts of those
    days are then read in full, and users counted.
    """
    by = tenant_keys(tenant_id)
    of_campaign = ads
    if campaign_id is not None:
        of_campaign = ads.filter(F.col("campaign_id") == campaign_id)
    else:
        by = [*by, "campaign_id"]
    rows = scope(impressions, tenant_id)
    seen = with_campaign(rows, of_campaign, "timestamp").select(
        *by, F.to_date("timestamp").alias("date")).distinct()
    latest = settle(_top(seen, by, days, F.desc("date")))
    # Calendar days: some hundreds, however many campaigns there are.
    dates = sorted(row[0] for row in latest.select("date").distinct().collect() if row[0])
    facts = with_campaign(_on_days(rows, dates), of_campaign, "user_id", "timestamp", "cost")
    facts = facts.withColumn("date", F.to_date("timestamp"))
    keys = [*by, "date"]
    listed = facts.join(lookup_side(latest.select(keys)), keys, "left_semi").groupBy(*keys).agg(
        F.count("*").alias("impressions"),
        F.sum("cost").alias("spend"),
        F.countDistinct("user_id").alias("unique_users"),
        mean_cost(F.sum("cost"), F.count("cost")).alias("avg_cpm"),
    )
    return listed.orderBy(*by, F.desc("date"))


def _on_days(rows: DataFrame, dates: list[date]) -> DataFrame:
    """Rows of some days; folders where the table has them by day, else a range of times."""
    if not dates:
        return rows.limit(0)
    if "date" in rows.columns:
        return rows.filter(F.col("date").isin(dates))
    first = moment(rows, datetime.combine(dates[0], time()))
    after = moment(rows, datetime.combine(dates[-1], time()) + timedelta(days=1))
    return rows.filter((F.col("timestamp") >= first) & (F.col("timestamp") < after))


def daily_aggregate(ads: DataFrame, impressions: DataFrame,
                    tenant_id: int | None = None) -> DataFrame:
    """Impressions and cost per campaign and day over the whole history.

    Counts and sums add up, so the facts are reduced per ad and day before the
    campaign is looked up.
    """
    by = tenant_keys(tenant_id)
    per_ad = scope(impressions, tenant_id).groupBy(
        "tenant_id", "ad_id", F.to_date("timestamp").alias("date")
    ).agg(F.count("*").alias("shown"), F.sum("cost").alias("cost"))
    lookup = ads.select(F.col("id").alias("ad_id"), "campaign_id")
    return per_ad.join(lookup, "ad_id").groupBy(*by, "campaign_id", "date").agg(
        F.sum("shown").alias("impressions"), F.sum("cost").alias("total_cost")
    ).orderBy(*by, "campaign_id", "date")

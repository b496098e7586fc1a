"""Synthetic campaign data of any size.

Every value is a hash of the row number, so a row is the same on every run,
whatever the partitioning, and a lost task recomputes it exactly.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape of the generated data.
CAMPAIGNS = 10
MIN_ADS, MAX_ADS = 3, 5
FIRST_USER, LAST_USER = 1000, 999_999
MIN_COST, MAX_COST = "0.05", "3.00"
CLICK_SHARE = 0.1
MAX_CLICK_DELAY = 300
MIN_BUDGET, MAX_BUDGET = 5_000, 50_000
FIRST_DAY, LAST_DAY = "2024-01-01", "2025-12-31"
CAMPAIGN_NAME, AUDIENCE_NAME = "Performance Campaign ", "Segment "
CREATIVE_PREFIX, CREATIVE_SUFFIX = "https://example.com/ad-", ".jpg"
SMALL_ROWS, SMALL_USERS, SMALL_DAYS = 1000, 100, 30
SMALL_MIN_COST, SMALL_MAX_COST = "0.10", "2.00"


def _draw(seed: int, name: str, below: int, key: str = "id") -> Column:
    """Uniform whole number from 0 up to ``below``."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(name), F.lit(seed)), F.lit(below))


def generate_campaigns(spark: SparkSession, tenant_id: int = 1, seed: int = 0) -> DataFrame:
    """Ten active campaigns with budgets between 5000 and 50000."""
    spread = (MAX_BUDGET - MIN_BUDGET) * 100 + 1
    cents = F.lit(MIN_BUDGET * 100) + _draw(seed, "budget", spread)
    return spark.range(1, CAMPAIGNS + 1).select(
        "id", F.lit(tenant_id).alias("tenant_id"),
        F.concat(F.lit(CAMPAIGN_NAME), F.col("id").cast("string")).alias("name"),
        (cents / 100).cast("decimal(12,2)").alias("budget"),
        F.lit("active").alias("status"),
        F.lit(FIRST_DAY).cast("date").alias("start_date"),
        F.lit(LAST_DAY).cast("date").alias("end_date"),
        F.lit(1).cast("bigint").alias("advertiser_id"),
    )


def generate_ads(campaigns: DataFrame, seed: int = 0) -> DataFrame:
    """Three to five ads per campaign, with ids counted per campaign."""
    number = F.lit(MIN_ADS) + _draw(seed, "ads", MAX_ADS - MIN_ADS + 1)
    each = campaigns.select(
        "tenant_id", F.col("id").alias("campaign_id"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)).alias("n"),
    )
    label = F.concat_ws("-", F.col("campaign_id").cast("string"), F.col("n").cast("string"))
    return each.select(
        (F.col("campaign_id") * MAX_ADS + F.col("n")).alias("id"), "tenant_id", "campaign_id",
        F.concat(F.lit(CREATIVE_PREFIX), label, F.lit(CREATIVE_SUFFIX)).alias("creative_url"),
        F.concat(F.lit(AUDIENCE_NAME), label).alias("target_audience"),
        F.lit(1).cast("bigint").alias("creative_id"), F.lit(1).cast("bigint").alias("audience_id"),
    )


def generate_impressions(spark: SparkSession, n: int, seed: int = 0, tenant_id: int = 1,
                         days_back: int = 90, as_of: datetime | None = None,
                         first_user: int = FIRST_USER, last_user: int = LAST_USER,
                         min_cost: str = MIN_COST, max_cost: str = MAX_COST,
                         single_ad: int | None = None, partitions: int | None = None) -> DataFrame:
    """``n`` impressions over the last days, at minute grain, on the generated ads."""
    low, high = round(float(min_cost) * 10_000), round(float(max_cost) * 10_000)
    campaign = F.lit(1) + _draw(seed, "campaign", CAMPAIGNS)
    number = F.lit(MIN_ADS) + F.pmod(
        F.xxhash64(campaign, F.lit("ads"), F.lit(seed)), F.lit(MAX_ADS - MIN_ADS + 1)
    )
    ad = campaign * MAX_ADS + F.pmod(F.xxhash64("id", F.lit("ad"), F.lit(seed)), number)
    end = F.current_timestamp() if as_of is None else F.lit(as_of.isoformat(sep=" ")).cast(
        "timestamp")
    minutes = _draw(seed, "minute", days_back * 24 * 60)
    rows = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(n)
    return rows.select(
        "id", F.lit(tenant_id).alias("tenant_id"),
        (ad if single_ad is None else F.lit(single_ad)).cast("bigint").alias("ad_id"),
        (F.lit(first_user) + _draw(seed, "user", last_user - first_user + 1)).alias("user_id"),
        (end - F.make_dt_interval(mins=minutes.cast("int"))).alias("timestamp"),
        ((F.lit(low) + _draw(seed, "cost", high - low + 1)) / 10_000).cast("decimal(10,4)")
        .alias("cost"),
    )


def generate_small(spark: SparkSession, ad_id: int, seed: int = 0, tenant_id: int = 1,
                   as_of: datetime | None = None) -> DataFrame:
    """The small form: a thousand impressions of one ad, a hundred users, thirty days."""
    return generate_impressions(spark, SMALL_ROWS, seed, tenant_id, SMALL_DAYS, as_of, 1,
                                SMALL_USERS, SMALL_MIN_COST, SMALL_MAX_COST, single_ad=ad_id)


def generate_clicks(impressions: DataFrame, seed: int = 0, share: float = CLICK_SHARE) -> DataFrame:
    """Clicks on about ``share`` of the impressions, one second to five minutes later."""
    chosen = _draw(seed, "click", 1_000_000) < round(share * 1_000_000)
    delay = F.lit(1) + _draw(seed, "delay", MAX_CLICK_DELAY)
    return impressions.filter(chosen).select(
        "id", "tenant_id", F.col("id").alias("impression_id"),
        (F.col("timestamp") + F.make_dt_interval(secs=delay.cast("decimal(18,6)")))
        .alias("timestamp"),
    )

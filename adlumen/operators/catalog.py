"""Tenant-scoped reads and counts over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.functions.measures import or_zero
from adlumen.functions.scope import scope, tenant_keys
from adlumen.schemas import ADMIN_ROLES


def tenant_table(table: DataFrame, tenant_id: int | None = None,
                 row_id: int | None = None) -> DataFrame:
    """A tenant's rows of any table, or one of them by id."""
    rows = scope(table, tenant_id)
    return rows if row_id is None else rows.filter(F.col("id") == row_id)


def ads_with_campaign(ads: DataFrame, campaigns: DataFrame, tenant_id: int | None = None,
                      ad_id: int | None = None) -> DataFrame:
    """Ads with the attributes of their campaign prefixed ``campaign_``."""
    owner = campaigns.select(
        F.col("id").alias("campaign_id"),
        *[F.col(c).alias(f"campaign_{c}") for c in campaigns.columns if c not in
          ("id", "tenant_id")],
    )
    return tenant_table(ads, tenant_id, ad_id).join(owner, "campaign_id")


def creative_urls(creatives: DataFrame, base_url: str, tenant_id: int | None = None) -> DataFrame:
    """Creatives with the address they are served from."""
    place = F.format_string("/tenant_%d/creative_%d", "tenant_id", "id")
    return scope(creatives, tenant_id).withColumn("cdn_url", F.concat(F.lit(base_url), place))


def distinct_campaign_count(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                            tenant_id: int | None = None) -> DataFrame:
    """Distinct campaigns over their left-joined ads and impressions.

    A left join never loses a campaign and the count ignores repeats, so
    Catalyst removes both joins and reads the campaigns only.
    """
    of = F.col("c.id")
    joined = (
        scope(campaigns, tenant_id).alias("c")
        .join(ads.alias("a"), of == F.col("a.campaign_id"), "left")
        .join(impressions.alias("i"), F.col("a.id") == F.col("i.ad_id"), "left")
    )
    by = [F.col("c.tenant_id")] if tenant_id is None else []
    return joined.groupBy(*by).agg(F.countDistinct(of).alias("campaigns"))


def tenant_stats(impressions: DataFrame, campaigns: DataFrame, ads: DataFrame,
                 tenant_id: int | None = None) -> DataFrame:
    """Number of impressions, campaigns and ads."""
    by = tenant_keys(tenant_id)

    def counted(table: DataFrame, name: str) -> DataFrame:
        return scope(table, tenant_id).groupBy("tenant_id").agg(F.count("*").alias(name))

    parts = (
        counted(impressions, "impressions")
        .unionByName(counted(campaigns, "campaigns"), allowMissingColumns=True)
        .unionByName(counted(ads, "ads"), allowMissingColumns=True)
    )
    return parts.groupBy(*by).agg(
        or_zero(F.sum("impressions")).alias("total_impressions"),
        or_zero(F.sum("campaigns")).alias("total_campaigns"),
        or_zero(F.sum("ads")).alias("total_ads"),
    )


def permission_check(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (tenant_id, user_id, resource, action) that a grant allows.

    A request naming no resource asks for nothing in particular and passes.
    """
    known = (F.col("tenant_id").isNotNull()) & (F.col("user_id").isNotNull())
    asked = requests.filter(known)
    free = asked.filter(F.col("resource").isNull() & F.col("action").isNull())
    named = asked.filter(F.col("resource").isNotNull() | F.col("action").isNotNull())
    rights = grants.select("tenant_id", "user_id", "resource", "action").distinct()
    return free.unionByName(
        named.join(rights, ["tenant_id", "user_id", "resource", "action"], "left_semi").select(
            *free.columns)
    )


def tenant_admins(users: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Users with an administrator role in their tenant."""
    own = scope(users, tenant_id).filter(F.col("tenant_id").isNotNull())
    return own.filter(F.col("role").isin(*ADMIN_ROLES))


def query_log_stats(timings: DataFrame, seconds: str = "seconds",
                    slow_over: float = 1.0) -> DataFrame:
    """Count, mean and maximum of query times and how many ran long."""
    taken = F.col(seconds)
    return timings.agg(
        F.count("*").alias("total_queries"),
        or_zero(F.avg(taken)).alias("avg_query_time"),
        or_zero(F.max(taken)).alias("max_query_time"),
        F.count_if(taken > slow_over).alias("slow_queries"),
    )

"""The joins every campaign report starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side


def ads_of_campaigns(campaigns: DataFrame, ads: DataFrame) -> DataFrame:
    """One row per ad of a known campaign: ad_id, campaign_id, tenant_id of the campaign.

    The two dimensions are joined first, so that the fact table is joined once.
    """
    owners = campaigns.select(F.col("id").alias("campaign_id"), "tenant_id")
    return ads.select(F.col("id").alias("ad_id"), "campaign_id").join(owners, "campaign_id")


def with_campaign(impressions: DataFrame, ads: DataFrame, *columns: str,
                  how: str = "inner") -> DataFrame:
    """Impressions with the campaign of their ad; the tenant is the impression's."""
    lookup = lookup_side(ads.select(F.col("id").alias("ad_id"), "campaign_id"))
    return impressions.select("tenant_id", "ad_id", *columns).join(lookup, "ad_id", how)


def under_campaigns(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                    *columns: str, same_tenant: bool = False) -> DataFrame:
    """Impressions with campaign and tenant of the campaign; ``same_tenant`` keeps
    only those the campaign's own tenant recorded."""
    lookup = lookup_side(ads_of_campaigns(campaigns, ads), bounded_by=ads)
    if same_tenant:
        rows = impressions.select("ad_id", "tenant_id", *columns)
        return rows.join(lookup, ["ad_id", "tenant_id"])
    return impressions.select("ad_id", *columns).join(lookup, "ad_id")

"""Position-based multi-touch attribution of revenue to campaigns.

A journey row is an impression with one of its clicks and one of that click's
conversions, either of which may be missing. The rows of a user are ordered in
time; weights are 1.0 when the user met the campaign on one day only, else 0.4
for the user's first row and for rows that convert, and 0.2 for the rest.

The rows themselves are never built. Everything the report needs is a sum over
them, and the only position that matters is the first, so conversions are
reduced per click, clicks per impression, and impressions per user and
campaign. All joins are then one to one: neither an impression with countless
clicks nor a user with countless impressions lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.scope import scope, tenant_keys
from adlumen.functions.sizing import lookup_side

# Attribution weights.
ONE_DAY_WEIGHT, FIRST_WEIGHT, CONVERTING_WEIGHT, OTHER_WEIGHT = "1.0", "0.4", "0.4", "0.2"


# A row's place in its user's journey is packed into one number: time in
# microseconds, then the id in 19 digits, then whether the row converts. Spark
# can take the minimum of numbers while aggregating by hash; for structs it
# would have to sort all impressions.
_ID_DIGITS = "1" + "0" * 19


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(2,1)")


def _place() -> Column:
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")).cast("decimal(17,0)")
    row = micros * F.lit(_ID_DIGITS).cast("decimal(20,0)") + F.col("id")
    flag = F.when(F.col("leads_converting"), F.lit(1)).otherwise(F.lit(0))
    return (row * F.lit(2).cast("decimal(1,0)") + flag).cast("decimal(38,0)")


def _product_sum(column: str, times: Column) -> Column:
    """Sum of products of two counts, exact where 64 bits would not hold them."""
    product = F.col(column).cast("decimal(20,0)") * times.cast("decimal(20,0)")
    return F.sum(product.cast("decimal(38,0)")).cast("decimal(38,0)")


def _impression_rows(impressions: DataFrame, ads: DataFrame, clicks: DataFrame,
                     conversions: DataFrame) -> DataFrame:
    """Impressions with the number of journey rows they stand for and their sums."""
    converted = conversions.groupBy(F.col("click_id").alias("id")).agg(
        F.count("*").alias("conversions"), F.sum("conversion_value").alias("value")
    )
    per_click = clicks.select("id", "impression_id").join(converted, "id", "left")
    clicked = per_click.groupBy(F.col("impression_id").alias("id")).agg(
        F.sum(F.greatest(F.coalesce("conversions", F.lit(0)), F.lit(1))).alias("clicks"),
        F.sum(F.coalesce("conversions", F.lit(0))).alias("conversions"),
        F.sum("value").alias("value"),
        F.min_by(F.col("conversions").isNotNull(), "id").alias("leads_converting"),
    )
    lookup = lookup_side(ads.select(F.col("id").alias("ad_id"), "campaign_id"))
    return (
        impressions.select("id", "tenant_id", "ad_id", "user_id", "timestamp")
        .join(clicked, "id", "left")
        .join(lookup, "ad_id", "left")
        .select(
            "id", "tenant_id", "user_id", "campaign_id", "timestamp", "value",
            F.coalesce("clicks", F.lit(1)).alias("rows"),
            F.coalesce("clicks", F.lit(0)).alias("clicks"),
            F.coalesce("conversions", F.lit(0)).alias("conversions"),
            F.coalesce("leads_converting", F.lit(False)).alias("leads_converting"),
        )
    )


def attribution(impressions: DataFrame, ads: DataFrame, clicks: DataFrame,
                conversions: DataFrame, tenant_id: int | None = None,
                campaign_id: int | None = None, mode: str = "reference",
                foreign_links: bool = False) -> DataFrame:
    """Users, revenue and counts per campaign, with the conversion rate.

    ``mode="reference"`` counts a user's campaign totals once per journey row,
    which is the established meaning of the report; ``mode="per_touch"`` lets
    each journey row contribute only itself. A campaign filter applies to the
    finished groups: the first touch is the user's first over all campaigns.
    A chain belongs to one tenant, so for one tenant only its own clicks and
    conversions are read; ``foreign_links`` follows those of others too. Totals
    are DECIMAL(38,0), since counts are multiplied.
    """
    if mode not in ("reference", "per_touch"):
        raise ValueError(f"unknown mode: {mode}")
    by = tenant_keys(tenant_id)
    if not foreign_links:
        clicks, conversions = scope(clicks, tenant_id), scope(conversions, tenant_id)
    rows = _impression_rows(scope(impressions, tenant_id), ads, clicks, conversions)
    touches = rows.groupBy(*by, "user_id", "campaign_id").agg(
        F.sum("rows").alias("rows"),
        F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum("value").alias("value"),
        F.min("timestamp").alias("first_touch"),
        F.max("timestamp").alias("last_touch"),
        F.min(_place()).alias("first_place"),
    )
    # One row per user and campaign from here on.
    user_start = F.min("first_place").over(Window.partitionBy(*by, "user_id"))
    touches = touches.withColumn("starts", F.col("first_place") == user_start).withColumn(
        "days", F.datediff("last_touch", "first_touch")
    ).filter(F.col("campaign_id").isNotNull() & F.col("user_id").isNotNull())

    one_day = F.col("days") == 0
    # The user's first row is lifted from "other" unless it converts anyway.
    converts = F.pmod("first_place", F.lit(2)) == 1
    lifted = F.when(F.col("starts") & ~converts, F.lit(1)).otherwise(F.lit(0))
    if mode == "reference":
        weight = F.when(one_day, F.col("rows") * _decimal(ONE_DAY_WEIGHT)).otherwise(
            lifted * _decimal(FIRST_WEIGHT)
            + F.col("conversions") * _decimal(CONVERTING_WEIGHT)
            + (F.col("rows") - F.col("conversions") - lifted) * _decimal(OTHER_WEIGHT)
        )
        times = F.col("rows")
    else:
        weight = F.when(one_day, _decimal(ONE_DAY_WEIGHT)).otherwise(_decimal(CONVERTING_WEIGHT))
        times = F.lit(1)
    result = touches.groupBy(*by, "campaign_id").agg(
        F.count("user_id").alias("attributed_users"),
        F.sum(F.col("value") * weight.cast("decimal(20,1)")).alias("attributed_revenue"),
        (F.sum(F.col("days").cast("decimal(10,0)") * F.col("rows").cast("decimal(18,0)"))
         / F.sum(F.col("rows").cast("decimal(18,0)"))).cast("decimal(24,4)")
        .alias("avg_journey_days"),
        _product_sum("rows", times).alias("total_impressions"),
        _product_sum("clicks", times).alias("total_clicks"),
        _product_sum("conversions", times).alias("total_conversions"),
    )
    if campaign_id is not None:
        result = result.filter(F.col("campaign_id") == campaign_id)
    rate = F.try_divide(F.col("total_conversions").cast("double"),
                        F.col("total_impressions").cast("double")) * 100
    return result.withColumn("conversion_rate", rate).orderBy(
        *by, F.desc_nulls_last("attributed_revenue"), "campaign_id"
    )

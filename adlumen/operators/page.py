"""A tenant's page from one pass over its impressions.

All parts of a page add up the same rows, so the rows are reduced once, to one
per user, day and campaign with counts and costs, and every part is computed
from that. ``open_page`` keeps the reduced rows for as long as the page is being
filled and releases them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlumen.functions.measures import frequency, mean_cost, or_zero
from adlumen.functions.scope import Moment, moment, scope, span
from adlumen.functions.sizing import lookup_side
from adlumen.operators.cohort import retention_of_days
from adlumen.operators.performance import daily_of_campaigns, ranked_campaigns
from adlumen.session import settle


def page_facts(ads: DataFrame, impressions: DataFrame, tenant_id: int, as_of: Moment = None,
               hours: int = 1) -> DataFrame:
    """One row per user, day and campaign: what was shown and spent, and of that the trailing hours.

    ``campaign_id`` is NULL where the ad is unknown. Spark adds the rows up
    per task before it shuffles, so a hot user or campaign is a few rows.
    """
    end = moment(impressions, as_of)
    recent = (F.col("timestamp") >= end - span(hours=hours)) & (F.col("timestamp") <= end)
    recent_cost = F.when(recent, F.col("cost"))
    lookup = lookup_side(ads.select(F.col("id").alias("ad_id"), "campaign_id"))
    rows = scope(impressions, tenant_id).select("ad_id", "user_id", "timestamp", "cost")
    reduced = rows.join(lookup, "ad_id", "left").groupBy(
        "user_id", "campaign_id", F.to_date("timestamp").alias("day")
    ).agg(
        F.count("*").alias("shown"), F.sum("cost").alias("cost"), F.count("cost").alias("costed"),
        F.count_if(recent).alias("recent_shown"), F.sum(recent_cost).alias("recent_cost"),
        F.count(recent_cost).alias("recent_costed"),
    )
    # Laid out by user once they are few: cohorts then need no exchange of their own.
    return reduced.repartition("user_id")


def _cohorts(facts: DataFrame) -> DataFrame:
    days = facts.filter(F.col("user_id").isNotNull()).groupBy("user_id", "day").agg(
        F.sum("shown").alias("impressions"), F.sum("cost").alias("spend"))
    return retention_of_days(days)


def _by_campaign(facts: DataFrame, *more: str) -> DataFrame:
    return facts.filter(F.col("campaign_id").isNotNull()).groupBy("campaign_id", *more)


def _total(name: str) -> Column:
    return F.sum(name).cast("decimal(20,4)")


def _top(campaigns: DataFrame, facts: DataFrame, tenant_id: int, limit: int) -> DataFrame:
    totals = _by_campaign(facts).agg(
        F.sum("shown").alias("total_impressions"), _total("cost").alias("total_spend"),
        F.countDistinct("user_id").alias("unique_users"))
    return ranked_campaigns(totals, scope(campaigns, tenant_id), limit)


def _days(campaigns: DataFrame, facts: DataFrame, tenant_id: int) -> DataFrame:
    days = _by_campaign(facts, F.col("day").alias("date")).agg(
        F.sum("shown").alias("impressions"), F.countDistinct("user_id").alias("unique_users"),
        _total("cost").alias("total_cost"),
        mean_cost(_total("cost"), F.sum("costed")).alias("avg_cost"))
    return daily_of_campaigns(days, scope(campaigns, tenant_id))


def _live(facts: DataFrame) -> DataFrame:
    users = F.countDistinct("user_id")
    recent = facts.filter((F.col("recent_shown") > 0) & F.col("campaign_id").isNotNull())
    return recent.agg(
        or_zero(F.sum("recent_shown")).alias("impressions_last_hour"),
        users.alias("unique_users"),
        or_zero(_total("recent_cost")).alias("spend_last_hour"),
        or_zero(mean_cost(_total("recent_cost"), F.sum("recent_costed"))).alias("avg_cpm"),
        or_zero(frequency(or_zero(F.sum("recent_shown")), users)).alias("frequency"))


def _totals(facts: DataFrame, log: DataFrame, tenant_id: int) -> DataFrame:
    """Log events, impression events and stored impressions, by a union of two small rows."""
    events = scope(log, tenant_id).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event_type") == "impression_created").alias("impression_events"))
    stored = facts.agg(F.sum("shown").alias("stored"))
    return events.unionByName(stored, allowMissingColumns=True).agg(
        or_zero(F.sum("events")).alias("total_events"),
        or_zero(F.sum("impression_events")).alias("total_impression_events"),
        or_zero(F.sum("stored")).alias("total_impressions"))


def page_parts(campaigns: DataFrame, facts: DataFrame, log: DataFrame, tenant_id: int,
               kind: str = "realtime") -> dict[str, DataFrame]:
    """The parts of a page, each from the rows of ``page_facts``.

    ``realtime``: live metrics, first ten cohort rows, five best campaigns, totals.
    ``overview``: whole cohort table, five best campaigns, totals.
    ``analysis``: whole cohort table, first five performance rows, ten best campaigns.
    """
    if kind == "analysis":
        return {"cohort_analysis": _cohorts(facts),
                "performance_metrics": _days(campaigns, facts, tenant_id).limit(5),
                "top_campaigns": _top(campaigns, facts, tenant_id, 10)}
    page = {"cohort_data": _cohorts(facts), "top_campaigns": _top(campaigns, facts, tenant_id, 5),
            "totals": _totals(facts, log, tenant_id)}
    if kind == "realtime":
        page["cohort_data"] = page["cohort_data"].limit(10)
        page["realtime_metrics"] = _live(facts)
    elif kind != "overview":
        raise ValueError(f"unknown dashboard: {kind}")
    return page


@contextmanager
def open_page(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame, log: DataFrame,
              tenant_id: int, as_of: Moment = None, kind: str = "realtime"
              ) -> Iterator[dict[str, DataFrame]]:
    """The parts of a page over one kept input, which is released when the page is closed.

    A lost executor costs its share of the kept rows, which are then read again.
    """
    facts = page_facts(ads, impressions, tenant_id, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts.count()  # parts that start at once would each begin to fill it
        yield page_parts(campaigns, facts, log, tenant_id, kind)
    finally:
        facts.unpersist()


def dashboard_bundle(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                     log: DataFrame, tenant_id: int, as_of: Moment = None,
                     kind: str = "realtime") -> dict[str, DataFrame]:
    """The parts of a page to be read at any time later: their input is written out once."""
    facts = settle(page_facts(ads, impressions, tenant_id, as_of))
    return page_parts(campaigns, facts, log, tenant_id, kind)

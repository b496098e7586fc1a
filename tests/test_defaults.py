"""Operators without ``as_of`` look at the current time, on both kinds of timestamp."""

import pytest
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.operators import cohort, eventlog, jobs, live, performance, warehouse
from adlumen.operators import placement
from tests.tables import ads, campaigns, rows_of


@pytest.fixture(params=["timestamp", "timestamp_ntz"])
def facts(spark, request):
    """Impressions five minutes, three hours and forty days ago."""
    ages = spark.createDataFrame([(1, 5), (2, 180), (3, 57600)], "id bigint, minutes int")
    when = (F.current_timestamp() - F.make_dt_interval(mins=F.col("minutes"))).cast(request.param)
    return ages.select("id", F.lit(1).alias("tenant_id"), F.lit(11).cast("bigint").alias("ad_id"),
                       F.lit(7).cast("bigint").alias("user_id"), when.alias("timestamp"),
                       F.lit("1").cast("decimal(10,4)").alias("cost"))


def test_current_time(spark, facts):
    placed, known = ads(spark, [(11, 1, 1)]), campaigns(spark, [(1, 1, "one", "10", "active", "02-01")])
    assert rows_of(live.realtime_metrics(facts, placed, 1), "impressions_last_hour") == [(1,)]
    assert rows_of(live.spend_last_hour(facts, 1)) == [(1.0,)]
    assert rows_of(live.bid_price(facts, 1)) == [(1, 0.9, "medium")]
    today = rows_of(live.impressions_on_day(facts, 1))[0][0]
    assert today in (0, 1, 2)    # midnight may lie in between
    assert rows_of(live.dashboard_totals(known, placed, facts, 1), "impressions_today") == [(today,)]
    assert rows_of(live.top_campaign_on_day(known, placed, facts, 1), "id", "impressions") == [
        (1, today)]
    assert rows_of(jobs.daily_metrics(known, placed, facts), "impressions") == [(today,)]
    assert performance.hourly_trend(placed, facts, 1, 1).count() == 2
    assert performance.campaign_ranking(known, placed, facts, 1).count() == 1
    assert warehouse.sync_impressions(facts, placed, 1).count() == 2
    periods = rows_of(cohort.advanced_cohort(facts, 1), "period_days", "total_impressions")
    assert sum(n for _, n in periods) == 3 and min(p for p, _ in periods) < 0
    log = facts.selectExpr("*", "'impression_created' as event_type")
    assert rows_of(eventlog.event_stats(log, 1), "total_events", "events_last_hour") == [(3, 1)]
    assert eventlog.retained_events(log).count() == 2


def test_lookups_beyond_the_bound_are_joined_by_shuffle(spark, facts, monkeypatch):
    placed, known = ads(spark, [(11, 1, 1)]), campaigns(spark, [(1, 1, "one", "10", "active", "02-01")])
    small = performance.top_campaigns(known, placed, facts, 1)
    monkeypatch.setattr(placement, "lookup_side",
                        lambda lookup, bounded_by=None: lookup_side(lookup, bounded_by, rows=0))
    large = performance.top_campaigns(known, placed, facts, 1)
    assert rows_of(small) == rows_of(large)
    marked = [df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")
              for df in (small, large)]
    assert marked == [1, 0]

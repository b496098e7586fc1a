from adlumen.operators import live, page
from tests.tables import NOW, ads, campaigns, day, impressions, rows_of

TODAY = day("03-01")


def facts(spark):
    return impressions(spark, [
        (1, 1, 11, 7, "03-01 10:59", "9"),     # a minute too old
        (2, 1, 11, 7, "03-01 11:00", "1"),     # exactly one hour back
        (3, 1, 12, 8, "03-01 12:00", "2"),     # exactly now
        (4, 1, 12, 8, "03-01 11:30", "2"),
        (5, 1, 11, 8, "03-01 12:01", "4"),     # after now
        (6, 1, 99, 8, "03-01 11:30", "4"),     # unknown ad
        (7, 1, 21, 9, "02-29 11:30", "4"),     # yesterday
    ])


def ad_rows(spark):
    return ads(spark, [(11, 1, 1), (12, 1, 1), (21, 1, 2)])


def campaign_rows(spark):
    return campaigns(spark, [(1, 1, "one", "10", "active", "02-01"),
                             (2, 1, "two", "10", "active", "02-01"),
                             (3, 1, "three", "10", "draft", "02-01"),
                             (4, 2, "four", "10", "active", "02-01")])


def test_trailing_hour_includes_both_ends(spark):
    found = live.realtime_metrics(facts(spark), ad_rows(spark), 1, as_of=NOW)
    assert rows_of(found) == [(3, 2, 5.0, 1.66666667, 1.5)]


def test_empty_hour_gives_zeros(spark):
    for tenant, campaign in ((2, None), (1, 2)):
        found = live.realtime_metrics(facts(spark), ad_rows(spark), tenant, campaign, NOW)
        assert rows_of(found) == [(0, 0, 0.0, 0.0, 0.0)]


def test_campaign_status(spark):
    one = live.campaign_live_metrics(facts(spark), ad_rows(spark), 1, 1, NOW)
    two = live.campaign_live_metrics(facts(spark), ad_rows(spark), 1, 2, NOW)
    assert rows_of(one) == [(3, 2, 5.0, 1.66666667, 1.5, "active")]
    assert rows_of(two) == [(0, 0, 0.0, 0.0, 0.0, "idle")]
    every = live.campaign_live_metrics(facts(spark), ad_rows(spark), as_of=NOW,
                                       campaigns=campaign_rows(spark))
    assert sorted(rows_of(every, "tenant_id", "campaign_id", "status")) == [
        (1, 1, "active"), (1, 2, "idle"), (1, 3, "idle"), (2, 4, "idle")]


def test_day_counts(spark):
    assert rows_of(live.impressions_on_day(facts(spark), 1, TODAY)) == [(6,)]
    assert rows_of(live.impressions_on_day(facts(spark), 2, TODAY)) == [(0,)]
    assert rows_of(live.unique_users_on_day(facts(spark), 1, TODAY)) == [(2,)]
    assert rows_of(live.unique_users_on_day(facts(spark), 1, TODAY, approximate=True)) == [(2,)]
    assert rows_of(live.spend_last_hour(facts(spark), 1, NOW)) == [(9.0,)]
    assert rows_of(live.spend_last_hour(facts(spark), 2, NOW)) == [(0.0,)]
    assert rows_of(live.active_campaign_count(campaign_rows(spark), 1)) == [(2,)]


def test_top_campaign_of_a_day(spark):
    args = campaign_rows(spark), ad_rows(spark), facts(spark)
    assert rows_of(live.top_campaign_on_day(*args, 1, TODAY)) == [(1, "one", 5, 1)]
    # Nothing shown: all campaigns tie at zero and the lowest id wins.
    assert rows_of(live.top_campaign_on_day(*args, 1, day("01-01"))) == [(1, "one", 0, 1)]
    assert rows_of(live.top_campaign_on_day(*args, 9, TODAY)) == []


def test_dashboard_counts_active_campaigns_without_traffic(spark):
    args = campaign_rows(spark), ad_rows(spark), facts(spark)
    assert rows_of(live.dashboard_totals(*args, 1, TODAY)) == [(2, 5, 18.0, 2)]
    assert sorted(rows_of(live.dashboard_totals(*args, day=TODAY))) == [
        (1, 2, 5, 18.0, 2), (2, 1, 0, 0.0, 0)]
    assert rows_of(live.dashboard_totals(*args, 9, TODAY)) == [(0, 0, 0.0, 0)]


def bid(spark, volume, cost, tenant=1):
    rows = [(i, 1, 11, 7, "03-01 11:50", cost) for i in range(volume)]
    return rows_of(live.bid_price(impressions(spark, rows), tenant, NOW))


def test_bid_price_steps(spark):
    assert bid(spark, 0, "1") == [(1, 0.45, "medium")]
    assert bid(spark, 50, "1") == [(1, 0.9, "medium")]
    assert bid(spark, 51, "1") == [(1, 0.9, "high")]
    assert bid(spark, 100, "1") == [(1, 0.9, "high")]
    assert bid(spark, 101, "1") == [(1, 1.1, "high")]
    assert bid(spark, 10, "0") == [(1, 0.45, "medium")]   # a mean of zero counts as none


def test_bid_price_of_every_tenant(spark):
    rows = impressions(spark, [(1, 1, 11, 7, "03-01 11:50", "2")])
    found = live.bid_price(rows, as_of=NOW, tenants=campaign_rows(spark).select("tenant_id"))
    assert sorted(rows_of(found)) == [(1, 1.8, "medium"), (2, 0.45, "medium")]


def test_bundles(spark):
    log = spark.createDataFrame([(1, "impression_created"), (1, "other")],
                                "tenant_id int, event_type string")
    for kind, parts in (
        ("realtime", {"cohort_data", "top_campaigns", "totals", "realtime_metrics"}),
        ("overview", {"cohort_data", "top_campaigns", "totals"}),
        ("analysis", {"cohort_analysis", "performance_metrics", "top_campaigns"}),
    ):
        parts_found = page.dashboard_bundle(
            campaign_rows(spark), ad_rows(spark), facts(spark), log, 1, NOW, kind)
        assert set(parts_found) == parts
        if "totals" in parts_found:
            assert rows_of(parts_found["totals"]) == [(2, 1, 7)]

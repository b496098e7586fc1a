from adlumen.operators import performance as p
from tests.tables import NOW, ads, campaigns, day, impressions, rows_of


def campaign_rows(spark):
    return campaigns(spark, [
        (1, 1, "one", "10.00", "active", "02-20"),
        (2, 1, "two", "0.00", "active", "03-01"),      # no budget, starts at as_of
        (3, 1, "three", "10.00", "active", "02-20"),   # no ads
        (4, 1, "four", "10.00", "paused", "02-20"),
        (5, 2, "five", "10.00", "active", "02-20"),
    ])


def ad_rows(spark):
    return ads(spark, [(11, 1, 1), (12, 1, 1), (21, 1, 2), (41, 1, 4), (51, 2, 5)])


def growth(spark):
    return impressions(spark, [
        (1, 1, 11, 7, "02-20 10:00", "1.0000"),
        (2, 1, 12, 8, "02-20 11:00", "2.0000"),
        (3, 1, 11, 7, "02-23 10:00", "1.0000"),   # two days missing in between
        (4, 1, 11, 7, "02-24 10:00", "1.0000"),
        (5, 1, 12, 7, "02-24 10:30", "0.3333"),
        (6, 1, 12, 9, "02-24 11:00", "1.0000"),
        (7, 1, 11, 9, "02-25 11:00", "1.0000"),   # as many as on 02-23
        (8, 1, 21, 7, "03-01 10:00", "1.0000"),
        (9, 1, 41, 7, "03-01 10:00", "1.0000"),
        (10, 2, 51, 7, "03-01 11:30", "2.0000"),
        (11, 1, 99, 7, "03-01 10:00", "1.0000"),  # unknown ad
    ])


def test_daily_growth_uses_listed_days(spark):
    found = p.campaign_daily_performance(campaign_rows(spark), ad_rows(spark), growth(spark), 1)
    assert rows_of(found.filter("campaign_id = 1"), "date", "impressions", "total_cost", "avg_cost",
                   "unique_users", "daily_rank", "prev_day_impressions", "growth_rate") == [
        (day("02-25"), 1, 1.0, 1.0, 1, 4, 3, -66.67),
        (day("02-24"), 3, 2.3333, 0.77776667, 2, 1, 1, 200.0),
        (day("02-23"), 1, 1.0, 1.0, 1, 3, 2, -50.0),
        (day("02-20"), 2, 3.0, 1.5, 2, 2, None, None),
    ]


def test_daily_covers_paused_campaigns_and_skips_those_without_ads(spark):
    found = p.campaign_daily_performance(campaign_rows(spark), ad_rows(spark), growth(spark))
    assert {row[0] for row in rows_of(found, "campaign_id")} == {1, 2, 4, 5}
    assert found.columns[0] == "tenant_id"


def test_top_campaigns_ties_share_a_rank(spark):
    found = p.top_campaigns(campaign_rows(spark), ad_rows(spark), growth(spark), 1)
    assert rows_of(found, "id", "total_impressions", "avg_cpm", "impression_rank",
                   "efficiency_rank") == [
        (1, 7, 1.0476, 1, 3), (2, 1, 1.0, 2, 1), (4, 1, 1.0, 2, 1),
    ]
    assert rows_of(p.top_campaigns(campaign_rows(spark), ad_rows(spark), growth(spark), 1, 2),
                   "id") == [(1,), (2,)]


def test_ranking_of_active_campaigns(spark):
    found = p.campaign_ranking(campaign_rows(spark), ad_rows(spark), growth(spark), 1, as_of=NOW)
    assert rows_of(found, "campaign_id", "total_impressions", "frequency", "days_running",
                   "budget_utilization", "daily_impression_rate", "impression_rank",
                   "efficiency_rank", "reach_rank", "overall_score") == [
        (1, 7, 2.3333, 10, 73.33, 1.0, 1, 2, 1, 1.3),
        (2, 1, 1.0, 0, None, None, 2, 1, 2, 1.7),   # no budget and no days: NULL
    ]
    assert "tenant_id" not in found.columns


def test_ranking_counts_only_own_tenants_impressions(spark):
    facts = impressions(spark, [(1, 2, 11, 7, "02-20 10:00", "1")])  # ad of tenant 1
    for tenant in (1, 2, None):
        found = p.campaign_ranking(campaign_rows(spark), ad_rows(spark), facts, tenant, as_of=NOW)
        assert found.count() == 0


def test_hourly_trend(spark):
    facts = impressions(spark, [
        (1, 1, 11, 7, "02-29 11:59", "1"),   # one minute too old
        (2, 1, 11, 7, "02-29 12:00", "1"),
        (3, 1, 12, 8, "02-29 15:10", "1"),
        (4, 1, 12, 8, "02-29 15:20", "2"),
        (5, 1, 21, 8, "02-29 15:20", "2"),   # other campaign
        (6, 1, 11, 8, "03-01 12:30", "2"),   # in the future
    ])
    found = p.hourly_trend(ad_rows(spark), facts, 1, 1, 24, NOW)
    assert rows_of(found) == [
        ("2024-02-29 15:00:00", 2, 1, 3.0, 1.5, 1, 100.0),
        ("2024-02-29 12:00:00", 1, 1, 1.0, 1.0, None, 0.0),
    ]


def test_warehouse_performance_starts_at_zero_growth(spark):
    joined = growth(spark).join(ad_rows(spark).selectExpr("id as ad_id", "campaign_id"), "ad_id")
    found = p.warehouse_daily_performance(joined, 1, 1, as_of=NOW)
    assert rows_of(found, "date", "prev_day_impressions", "growth_rate") == [
        (day("02-25"), 3, -66.67), (day("02-24"), 1, 200.0), (day("02-23"), 2, -50.0),
        (day("02-20"), None, 0.0),
    ]


def test_report_and_aggregate(spark):
    report = p.campaign_report(ad_rows(spark), growth(spark), 1, 1, days=2)
    assert rows_of(report, "date", "impressions", "spend") == [
        (day("02-25"), 1, 1.0), (day("02-24"), 3, 2.3333)]
    whole = p.daily_aggregate(ad_rows(spark), growth(spark), 1)
    assert rows_of(whole)[:2] == [(1, day("02-20"), 2, 3.0), (1, day("02-23"), 1, 1.0)]
    assert whole.count() == 6


def test_missing_cost_and_user_are_left_out_of_means_and_reach(spark):
    facts = impressions(spark, [(1, 1, 11, None, "02-20 10:00", None), (2, 1, 11, 7, "02-20 10:00", "3")])
    found = p.campaign_daily_performance(campaign_rows(spark), ad_rows(spark), facts, 1)
    assert rows_of(found, "impressions", "total_cost", "avg_cost", "unique_users") == [(2, 3.0, 3.0, 1)]

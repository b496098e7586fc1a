from datetime import timedelta

from adlumen.functions.scope import date_range_filter, trailing
from adlumen.operators import catalog
from adlumen.plans import facts
from adlumen.sources import generate as g
from tests.tables import NOW, ads, at, campaigns, impressions, rows_of


def campaign_rows(spark):
    return campaigns(spark, [(1, 1, "one", "10", "active", "02-01"),
                             (2, 2, "two", "10", "active", "02-01")])


def test_tenant_reads(spark):
    rows = campaign_rows(spark)
    assert rows_of(catalog.tenant_table(rows, 2), "id") == [(2,)]
    assert catalog.tenant_table(rows, 2, 1).count() == 0
    listed = catalog.ads_with_campaign(ads(spark, [(11, 1, 1), (12, 1, 9)]), rows, 1)
    assert rows_of(listed, "id", "campaign_name") == [(11, "one")]


def test_counts(spark):
    shown = impressions(spark, [(1, 1, 11, 7, "02-01 10:00", "1")])
    args = campaign_rows(spark), ads(spark, [(11, 1, 1)]), shown
    counted = catalog.distinct_campaign_count(*args)
    assert sorted(rows_of(counted)) == [(1, 1), (2, 1)]
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(catalog.tenant_stats(shown, args[0], args[1], 1)) == [(1, 1, 1)]
    assert rows_of(catalog.tenant_stats(shown, args[0], args[1], 9)) == [(0, 0, 0)]


def test_permissions(spark):
    grants = spark.createDataFrame([(1, 7, "campaign", "edit")],
                                   "tenant_id int, user_id bigint, resource string, action string")
    asked = spark.createDataFrame(
        [(1, 7, "campaign", "edit"), (1, 7, "campaign", "delete"), (2, 7, "campaign", "edit"),
         (1, 8, None, None), (None, 7, "campaign", "edit")], grants.schema)
    assert sorted(rows_of(catalog.permission_check(asked, grants)), key=str) == [
        (1, 7, "campaign", "edit"), (1, 8, None, None)]
    users = spark.createDataFrame([(1, 1, "admin"), (2, 1, "user"), (3, 1, "super_admin"),
                                   (4, None, "admin")], "id bigint, tenant_id int, role string")
    assert sorted(rows_of(catalog.tenant_admins(users), "id")) == [(1,), (3,)]


def test_query_log(spark):
    timings = spark.createDataFrame([(0.5,), (1.0,), (4.5,)], "seconds double")
    assert rows_of(catalog.query_log_stats(timings)) == [(3, 2.0, 4.5, 1)]
    assert rows_of(catalog.query_log_stats(timings.limit(0))) == [(0, 0.0, 0.0, 0)]


def test_range_filter_is_inclusive(spark):
    rows = impressions(spark, [(i, 1, 1, 1, f"02-0{i} 10:00", "1") for i in range(1, 5)])
    found = date_range_filter(rows, 1, at("02-02 10:00"), at("02-03 10:00"))
    assert sorted(rows_of(found, "id")) == [(2,), (3,)]
    assert date_range_filter(rows).count() == 4
    assert date_range_filter(rows, 2).count() == 0


def test_time_filters_reach_the_scan(spark, capsys):
    rows = facts.volume_impressions(spark, "/root/testdata/sf0.001")
    trailing(rows, NOW, days=3).select("ad_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThanOrEqual(l_shipdate" in plan


def test_generated_data_is_repeatable(spark):
    shops = g.generate_campaigns(spark)
    placed = g.generate_ads(shops)
    per_campaign = rows_of(placed.groupBy("campaign_id").count(), "count")
    assert shops.count() == 10 and {n for n, in per_campaign} <= {3, 4, 5}
    one = g.generate_impressions(spark, 5000, as_of=NOW)
    two = g.generate_impressions(spark, 5000, as_of=NOW, partitions=13)
    assert one.exceptAll(two).count() == 0
    assert one.join(placed.selectExpr("id as ad_id"), "ad_id").count() == 5000
    low = one.selectExpr("min(user_id)", "max(user_id)", "min(cost)", "max(cost)",
                         "min(timestamp)", "max(timestamp)").first()
    assert low[0] >= 1000 and low[1] <= 999_999
    assert 0.05 <= low[2] < 0.1 and 2.9 < low[3] <= 3.0
    assert NOW - timedelta(days=90) <= low[4] and low[5] <= NOW
    share = g.generate_clicks(one).count() / 5000
    assert 0.08 < share < 0.12
    small = g.generate_small(spark, 4, as_of=NOW)
    assert small.count() == 1000 and small.select("ad_id").distinct().count() == 1

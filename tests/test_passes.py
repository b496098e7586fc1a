"""Plans of operators that look at few columns first, and streams of any length."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adlumen.operators import eventlog, page
from adlumen.operators.cohort import advanced_cohort, cohort_retention
from adlumen.operators.live import realtime_metrics
from adlumen.operators.performance import campaign_daily_performance, campaign_report, top_campaigns
from adlumen.sources.tables import append_rows, read_table
from tests.tables import ads, campaigns

NOW = datetime(2024, 3, 1, 12)


def facts(spark, count=400, users=40):
    draw = random.Random(7)
    rows = [(i, 1 + i % 2, 11 + i % 4, draw.randrange(users) or None,
             NOW - timedelta(minutes=draw.randrange(90 * 1440)), f"{draw.randrange(1, 300) / 100}")
            for i in range(count)]
    rows += [(count + i, 1, 11, 3, NOW - timedelta(minutes=i), None) for i in range(5)]
    return spark.createDataFrame(
        rows, "id long, tenant_id int, ad_id long, user_id long, timestamp timestamp_ntz, cost string"
    ).withColumn("cost", F.col("cost").cast("decimal(10,4)"))


def dims(spark):
    return (campaigns(spark, [(1, 1, "one", "1", "active", "01-01"), (2, 1, "two", "1", "active", "01-01"),
                              (3, 2, "other", "1", "active", "01-01")]),
            ads(spark, [(11, 1, 1), (12, 2, 3), (13, 1, 2)]))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def same(left, right):
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.select(*left.columns).collect()))


def numbers(df):
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n)
                       for n, t in df.dtypes])


def test_page_parts_equal_the_reports(spark):
    owners, known = dims(spark)
    shown = facts(spark)
    log = spark.createDataFrame([(1, "impression_created"), (1, "x"), (2, "x")], "tenant_id int, event_type string")
    with page.open_page(owners, known, shown, log, 1, NOW) as parts:
        same(numbers(parts["cohort_data"]), numbers(cohort_retention(shown, 1).limit(10)))
        same(numbers(parts["top_campaigns"]), numbers(top_campaigns(owners, known, shown, 1, limit=5)))
        same(numbers(parts["realtime_metrics"]), numbers(realtime_metrics(shown, known, 1, as_of=NOW)))
        assert tuple(parts["totals"].first()) == (2, 1, shown.filter("tenant_id = 1").count())
        assert all("InMemoryRelation" in plan_of(p) for p in parts.values())
    whole = page.dashboard_bundle(owners, known, shown, log, 1, NOW, "analysis")
    same(numbers(whole["performance_metrics"]), numbers(
        campaign_daily_performance(owners, known, shown, 1).limit(5)))
    same(numbers(whole["cohort_analysis"]), numbers(cohort_retention(shown, 1)))
    with pytest.raises(ValueError):
        page.dashboard_bundle(owners, known, shown, log, 1, NOW, "unknown")


def test_a_page_of_an_idle_tenant(spark):
    owners, known = dims(spark)
    log = spark.createDataFrame([], "tenant_id int, event_type string")
    parts = page.dashboard_bundle(owners, known, facts(spark), log, 9, NOW)
    assert [r[0] for r in parts["realtime_metrics"].collect()] == [0]
    assert tuple(parts["totals"].first()) == (0, 0, 0) and parts["cohort_data"].count() == 0


def test_history_is_cut_to_the_openers_before_it_is_shuffled(spark):
    shown = facts(spark)
    found = advanced_cohort(shown, days_back=2, as_of=NOW)
    text = found._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("partial_count"):]
    assert "LeftSemi" in below and below.index("LeftSemi") < below.index("Scan")
    assert "BroadcastHashJoin" in below[:below.index("Scan")]
    assert found.count() > 0


def test_report_reads_the_listed_days_only(spark, tmp_path):
    owners, known = dims(spark)
    root = str(tmp_path)
    append_rows(facts(spark).withColumn("timestamp", F.col("timestamp").cast("timestamp")), root, "impression")
    stored = read_table(spark, root, "impression")
    found = campaign_report(known, stored, days=3)
    plan = plan_of(found)
    line = next(x for x in plan.splitlines() if "PartitionFilters: [" in x and "date" in x.split("PartitionFilters")[1])
    assert "IN (" in line or "INSET" in line or "= " in line
    days = facts(spark).filter("ad_id in (11, 12, 13)").groupBy(
        "tenant_id", "ad_id", F.to_date("timestamp").alias("date")).count()
    expected = sorted((r.tenant_id, r.date) for r in found.collect())
    assert len(expected) == 3 * days.select("tenant_id", "ad_id").distinct().count()


@pytest.mark.parametrize("limit", [1, 37, 5000])
def test_event_streams_of_any_limit(spark, limit):
    draw = random.Random(limit)
    count = 12_000 if limit == 5000 else 900
    rows = [(i, 1 + i % 2, "x", str(draw.choice([5, 5, 5, 6])), "{}",
             datetime(2024, 3, 1) + timedelta(minutes=draw.randrange(3000)), i) for i in range(count)]
    log = spark.createDataFrame(rows, "id long, tenant_id int, event_type string, aggregate_id string, "
                                "payload string, timestamp timestamp_ntz, sequence_number long")
    found = eventlog.event_stream(log, limit=limit, few=0)
    assert "row_number" not in plan_of(found)
    expected = set()
    for tenant in (1, 2):
        for key in "56":
            mine = sorted(((r[5], r[0]) for r in rows if r[1] == tenant and r[3] == key), reverse=True)
            expected |= {(tenant, key, i) for _, i in mine[:limit]}
    assert {(r.tenant_id, r.aggregate_id, r.event_id) for r in found.collect()} == expected
    alone = [r.event_id for r in eventlog.event_stream(log, 1, 5, limit, few=0).collect()]
    mine = sorted(((r[5], r[0]) for r in rows if r[1] == 1 and r[3] == "5"), reverse=True)
    assert alone == [i for _, i in mine[:limit]]
    assert eventlog.event_stream(log.limit(0), limit=limit, few=0).count() == 0

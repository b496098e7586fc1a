"""Folders are pruned by day, tenants reach the scan, idle tenants are listed."""

from datetime import datetime

import pytest

from adlumen.functions.scope import date_range_filter
from adlumen.operators import eventlog, performance, warehouse
from adlumen.plans import facts

FOLDER = "/root/testdata/sf0.001"
NOON = datetime(2024, 1, 20, 12)


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("days") / "impression")
    facts.impressions(spark, FOLDER).withColumn("date", F.to_date("timestamp")).write.partitionBy(
        "date").parquet(path)
    return spark.read.parquet(path)


def scan(df) -> str:
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return "\n".join(line for line in plan.splitlines()
                     if line.startswith(("PartitionFilters", "PushedFilters")))


def test_day_folders_are_pruned(spark, by_day):
    ads = facts.ads(spark, FOLDER)
    frames = [
        date_range_filter(by_day, 1, NOON.replace(day=10), NOON),
        warehouse.sync_impressions(by_day, ads, after=warehouse.Mark(NOON, 0)),
        eventlog.retained_events(by_day, days=3, as_of=NOON),
    ]
    for frame in frames:
        assert "date" in scan(frame).split("PartitionFilters: [")[1].split("]")[0], scan(frame)


def test_one_tenant_reaches_the_scan(spark):
    shown = facts.impressions(spark, FOLDER)
    base = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr(
        "l_partkey AS ad_id", "CAST(l_linenumber AS INT) AS tenant_id", "l_orderkey AS user_id",
        "l_shipdate AS timestamp", "CAST(l_extendedprice AS DECIMAL(10,4)) AS cost")
    assert shown.count() and base.count()
    for operator in (performance.campaign_daily_performance, performance.top_campaigns):
        plan = scan(operator(facts.campaigns(spark, FOLDER), facts.ads(spark, FOLDER), base, 1))
        assert "l_linenumber" in plan

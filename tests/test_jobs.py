from datetime import datetime

from pyspark.sql import functions as F

from adlumen.operators import jobs, warehouse
from adlumen.operators.cohort import advanced_cohort
from adlumen.operators.performance import warehouse_daily_performance
from adlumen.sources.tables import append_rows, read_jdbc, read_table, write_version
from tests.tables import NOW, ads, at, campaigns, day, impressions, log, rows_of

TODAY = day("03-01")


def campaign_rows(spark):
    return campaigns(spark, [(1, 1, "one", "10", "active", "02-01"),
                             (2, 1, "two", "10", "paused", "02-01"),
                             (3, 2, "three", "10", "active", "02-01")])


def ad_rows(spark):
    return ads(spark, [(11, 1, 1), (21, 1, 2), (31, 2, 3)])


def facts(spark):
    return impressions(spark, [
        (1, 1, 11, 7, "03-01 00:00", "1"), (2, 1, 11, 8, "03-01 23:59", "2"),
        (3, 1, 11, 8, "02-29 23:59", "4"), (4, 2, 31, 8, "03-01 10:00", "8")])


def stored(spark):
    return spark.createDataFrame([
        (1, 1, TODAY, 9, 5, 2, 9.0), (1, 1, day("02-29"), 9, 5, 2, 9.0), (2, 3, TODAY, 9, 1, 1, 9.0),
    ], "tenant_id int, campaign_id bigint, date date, impressions bigint, clicks bigint, "
       "conversions bigint, spend double")


def test_upsert_keeps_clicks_and_other_rows(spark):
    fresh = jobs.daily_metrics(campaign_rows(spark), ad_rows(spark), facts(spark), 1, TODAY)
    assert sorted(rows_of(fresh)) == [(1, 1, TODAY, 2, 3.0), (1, 2, TODAY, 0, 0.0)]
    assert sorted(rows_of(jobs.daily_metrics_upsert(stored(spark), fresh))) == [
        (1, 1, day("02-29"), 9, 5, 2, 9.0),    # other date
        (1, 1, TODAY, 2, 5, 2, 3.0),           # updated, clicks kept
        (1, 2, TODAY, 0, 0, 0, 0.0),           # inserted with zeros
        (2, 3, TODAY, 9, 1, 1, 9.0),           # other tenant
    ]


def test_upsert_job_replaces_one_day_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for date in (day("02-29"), TODAY, TODAY):
        fresh = jobs.daily_metrics(campaign_rows(spark), ad_rows(spark), facts(spark), day=date)
        jobs.upsert_day(spark, path, fresh, date)
    found = spark.read.parquet(path)
    assert sorted(rows_of(found, "tenant_id", "campaign_id", "date", "impressions", "spend")) == [
        (1, 1, day("02-29"), 1, 4.0), (1, 1, TODAY, 2, 3.0), (1, 2, day("02-29"), 0, 0.0),
        (1, 2, TODAY, 0, 0.0), (2, 3, day("02-29"), 0, 0.0), (2, 3, TODAY, 1, 8.0)]


def test_replay_replaces_whole_campaigns(spark, tmp_path):
    replayed = spark.createDataFrame([(1, 1, day("01-05"), 3, 1, 0, 1.0, 2)],
                                     "tenant_id int, campaign_id bigint, date date, "
                                     "impressions bigint, clicks bigint, conversions bigint, "
                                     "spend double, unique_users bigint")
    rows = stored(spark).selectExpr("*", "cast(null as bigint) as unique_users")
    new = jobs.replace_replayed(rows, replayed, replayed.select("tenant_id", "campaign_id"))
    write_version(new, str(tmp_path / "v2"))
    assert sorted(rows_of(spark.read.parquet(str(tmp_path / "v2")), "tenant_id", "campaign_id",
                          "date")) == [(1, 1, day("01-05")), (2, 3, TODAY)]


def source(spark):
    return impressions(spark, [
        (1, 1, 11, 7, "02-10 10:00", "1"), (2, 1, 11, 7, "02-10 10:00", "1"),
        (3, 1, 11, 7, "02-10 10:00", "1"), (4, 1, 21, 7, "02-11 10:00", "1"),
        (5, 1, 99, 7, "02-12 10:00", "1"), (6, 2, 31, 7, "02-13 10:00", "1"),
        (7, 1, 11, 7, "01-01 10:00", "1")])    # older than thirty days


def test_selection_after_a_mark(spark):
    mark = warehouse.Mark(at("02-10 10:00"), 2)
    found = warehouse.sync_impressions(source(spark), ad_rows(spark), 1, mark)
    assert sorted(rows_of(found)) == [
        (1, 1, 11, 7, 1.0, at("02-10 10:00"), "US", "desktop"),
        (1, 2, 21, 7, 1.0, at("02-11 10:00"), "US", "desktop")]
    first = warehouse.sync_impressions(source(spark), ad_rows(spark), 1, batch_size=2, as_of=NOW)
    assert rows_of(first, "timestamp") == [(at("02-10 10:00"),)] * 2


def test_sync_in_batches_loses_no_ties_and_repeats_nothing(spark, tmp_path):
    path, marks = str(tmp_path / "copy"), str(tmp_path / "marks")
    sizes = []
    for _ in range(4):
        done = warehouse.sync_to_warehouse(spark, source(spark), ad_rows(spark), path, marks, 1,
                                           batch_size=2, as_of=NOW)
        sizes.append((done["synced_rows"], done["status"]))
    assert sizes == [(2, "success"), (2, "success"), (0, "no_new_data"), (0, "no_new_data")]
    copy = spark.read.parquet(path)
    assert sorted(rows_of(copy, "campaign_id", "timestamp")) == [
        (1, at("02-10 10:00"))] * 3 + [(2, at("02-11 10:00"))]
    # A run that died before its mark was written runs again into the same folder.
    again = str(tmp_path / "marks2")
    warehouse.sync_to_warehouse(spark, source(spark), ad_rows(spark), path, again, 1, 2, NOW)
    assert spark.read.parquet(path).count() == 4


def test_sync_of_zoned_timestamps(spark, tmp_path):
    path, marks = str(tmp_path / "copy"), str(tmp_path / "marks")
    zoned = source(spark).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    first = warehouse.sync_to_warehouse(spark, zoned, ad_rows(spark), path, marks, 1, as_of=NOW)
    assert first["synced_rows"] == 4 and first["last_timestamp"] == datetime(2024, 2, 11, 10)
    assert warehouse.sync_to_warehouse(spark, zoned, ad_rows(spark), path, marks, 1,
                                       as_of=NOW)["status"] == "no_new_data"


def test_copy_is_pruned_by_day(spark, tmp_path, capsys):
    path, marks = str(tmp_path / "copy"), str(tmp_path / "marks")
    warehouse.sync_to_warehouse(spark, source(spark), ad_rows(spark), path, marks, 1, as_of=NOW)
    copy = spark.read.parquet(path)
    found = warehouse_daily_performance(copy, 1, days_back=20, as_of=NOW)
    assert rows_of(found, "campaign_id", "date") == [(2, day("02-11"))]
    capsys.readouterr()
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "GreaterThanOrEqual(timestamp,2024-02-10T12:00)" in plan
    assert advanced_cohort(copy, 1, as_of=NOW).count() == 2
    assert rows_of(warehouse.sync_status(copy, 1))[0][:2] == (4, 2)
    assert rows_of(warehouse.sync_status(copy, 7)) == [(0, 0, None, None, "no_data")]


def test_declared_tables_round_trip(spark, tmp_path):
    root = str(tmp_path)
    append_rows(facts(spark), root, "impression")
    append_rows(facts(spark).filter("id = 1"), root, "impression")
    assert read_table(spark, root, "impression").count() == 5
    assert read_table(spark, root, "impression").filter("date = '2024-02-29'").count() == 1
    full = campaign_rows(spark).selectExpr("*", "1L as advertiser_id")
    append_rows(full, root, "campaign")
    assert sorted(rows_of(read_table(spark, root, "campaign"), "id")) == [(1,), (2,), (3,)]


def test_jdbc_needs_its_driver(spark):
    try:
        read_jdbc(spark, "jdbc:none:none", "t", {})
    except Exception as problem:
        assert "No suitable driver" in str(problem)


def test_expiry_drops_days_and_rewrites_only_the_cutoff(spark):
    rows = log(spark, [(1, 1, "x", "5", None, "02-01 10:00", 1), (2, 1, "x", "5", None, "02-20 10:00", 2),
                       (3, 1, "x", "5", None, "02-20 12:00", 3), (4, 2, "x", "5", None, "02-21 10:00", 1)])
    dated = rows.withColumn("date", F.to_date("timestamp"))
    dated.write.partitionBy("date").mode("overwrite").saveAsTable("kept_log")
    assert jobs.expire_log(spark, "kept_log", days=10, as_of=NOW) == 2
    assert sorted(rows_of(spark.table("kept_log"), "id")) == [(3,), (4,)]
    days = [r[0] for r in spark.sql("SHOW PARTITIONS kept_log").collect()]
    assert sorted(days) == ["date=2024-02-20", "date=2024-02-21"]
    assert jobs.expire_log(spark, "kept_log", days=10, as_of=NOW) == 0
    assert jobs.expire_log(spark, "kept_log", days=9, as_of=NOW) == 2    # the whole cutoff day
    assert spark.table("kept_log").count() == 0
    spark.sql("DROP TABLE kept_log")

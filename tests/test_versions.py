"""Tables published in one step: readers, rival writers, compaction, reserved numbers."""

from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.operators import eventlog, jobs, warehouse
from adlumen.sources import versions
from adlumen.sources.versions import NONE, VersionConflict

DAYS = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()),
                     T.StructField("date", T.DateType())])


def rows(spark, *data):
    return spark.createDataFrame(list(data), DAYS)


def content(spark, table, which=None):
    return sorted(map(tuple, versions.read_version(spark, table, DAYS, which).collect()), key=repr)


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "table")


D1, D2 = date(2024, 1, 1), date(2024, 1, 2)


def test_days_are_replaced_added_and_taken_over(spark, table):
    assert versions.current(spark, table) == NONE and content(spark, table) == []
    first = versions.publish(spark, table, rows(spark, (1, "a", D1), (2, "a", D2), (3, "a", None)), NONE)
    second = versions.publish(spark, table, rows(spark, (4, "b", D2)), first, [D2])
    assert content(spark, table) == [(1, "a", D1), (3, "a", None), (4, "b", D2)]
    third = versions.publish(spark, table, rows(spark, (5, "c", D2)), second, ())
    assert (4, "b", D2) in content(spark, table) and (5, "c", D2) in content(spark, table)
    versions.publish(spark, table, rows(spark, (6, "d", None)), third, [None])
    assert content(spark, table, first) == [(1, "a", D1), (2, "a", D2), (3, "a", None)]
    assert (6, "d", None) in content(spark, table) and (3, "a", None) not in content(spark, table)
    versions.publish(spark, table, rows(spark), versions.current(spark, table))
    assert content(spark, table) == []


def test_of_two_rivals_one_fails_and_leaves_nothing(spark, table):
    base = versions.publish(spark, table, rows(spark, (0, "base", D1)), NONE)

    def rival(name):
        try:
            versions.publish(spark, table, rows(spark, (1, name, D1), (2, name, D2)), base, [D1])
            return name
        except VersionConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [name for name in pool.map(rival, "abcd") if name]
    assert len(won) == 1 and content(spark, table) == [(1, won[0], D1), (2, won[0], D2)]
    listed = {p.folder.split("/")[0] for v in (1, 2) for p in versions.version(spark, table, v).parts}
    assert set(versions._names(spark, f"{table}/data")) == listed
    assert versions._names(spark, f"{table}/versions") == [f"{n:020d}" for n in (1, 2)]


def test_readers_never_see_a_mix(spark, table):
    versions.publish(spark, table, rows(spark, *[(k, "0", d) for k in range(40) for d in (D1, D2)]), NONE)

    def write():
        for turn in range(1, 6):
            versions.publish(spark, table, rows(
                spark, *[(k, str(turn), d) for k in range(40) for d in (D1, D2)]),
                versions.current(spark, table), [D1, D2])

    def read():
        seen = []
        for _ in range(12):
            found = content(spark, table)
            seen.append((len(found), len({v for _, v, _ in found})))
        return seen

    with ThreadPoolExecutor(3) as pool:
        writer, readers = pool.submit(write), [pool.submit(read) for _ in range(2)]
        writer.result()
        assert {s for r in readers for s in r.result()} == {(80, 1)}


def test_compaction_leaves_readers_and_open_days_alone(spark, table):
    now = NONE
    for turn in range(5):
        now = versions.publish(spark, table, rows(spark, (turn, "x", D1), (turn, "x", D2)), now, (),
                               note=f"mark {turn}")
    before = versions.read_version(spark, table, DAYS)
    expected = content(spark, table)
    done = versions.compact(spark, table, DAYS, D2)
    days = [p.day for p in done.parts]
    assert days.count("2024-01-01") == 1 and days.count("2024-01-02") == 5 and done.note == "mark 4"
    assert content(spark, table) == expected == sorted(map(tuple, before.collect()), key=repr)
    assert versions.compact(spark, table, DAYS, D2) == done
    assert versions.expire(spark, table, keep=1) == 5
    assert content(spark, table) == expected


METRIC = "tenant_id int, campaign_id long, date date, impressions long, clicks long, " \
         "conversions long, spend decimal(12,2), unique_users long"


def metrics(spark, *data):
    shaped = spark.createDataFrame([(*d, 0, 0, None, None) for d in data],
                                   METRIC.replace("decimal(12,2)", "string"))
    return shaped.select(*[F.col(f.name).cast(f.dataType) for f in jobs.METRICS.fields])


def log_rows(spark, *data):
    return spark.createDataFrame(
        [(i, 1, str(c), "impression_created", '{"user_id":"5","cost":"1.00"}', at)
         for i, c, at in data],
        "id long, tenant_id int, aggregate_id string, event_type string, payload string, "
        "timestamp timestamp")


def test_replay_rewrites_only_the_days_it_touches(spark, table):
    versions.publish(spark, table, metrics(
        spark, (1, 10, D1, 9), (1, 10, D2, 9), (1, 20, D2, 7), (1, 20, date(2024, 1, 9), 7)), NONE)
    first = versions.current(spark, table)
    log = log_rows(spark, (1, 10, datetime(2024, 1, 2, 5)), (2, 10, datetime(2024, 1, 3, 5)))
    done = jobs.replay_into(spark, table, log, campaign_id=10)
    found = {(r.campaign_id, str(r.date), r.impressions)
             for r in versions.read_version(spark, table, jobs.METRICS).collect()}
    assert found == {(10, "2024-01-02", 1), (10, "2024-01-03", 1), (20, "2024-01-02", 7),
                     (20, "2024-01-09", 7)}
    kept = set(first.parts) & set(done.parts)
    assert [p.day for p in kept] == ["2024-01-09"]
    # A rebuild on a version that is no longer the newest changes nothing.
    with pytest.raises(VersionConflict):
        versions.publish(spark, table, metrics(spark, (1, 1, D1, 1)), first)
    assert versions.current(spark, table) == done


def test_writers_at_once_get_gapless_numbers(spark, table):
    def batch(name, first, count):
        events = log_rows(spark, *[(first + i, 10 + i % 2, datetime(2024, 1, 1, 0, i % 60))
                                   for i in range(count)])
        return eventlog.append_reserved(spark, events, table, name).collect()

    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(batch, "abc", (0, 1000, 2000), (40, 31, 17)))
    for campaign in ("10", "11"):
        numbers = sorted(r.sequence_number for part in done for r in part if r.aggregate_id == campaign)
        assert numbers == list(range(1, len(numbers) + 1))
    # A writer that runs again gets the numbers it had.
    again = batch("b", 1000, 31)
    assert {(r.id, r.sequence_number) for r in again} == {(r.id, r.sequence_number) for r in done[1]}
    assert max(r.sequence_number for r in batch("d", 3000, 2)) > max(
        r.sequence_number for part in done for r in part) - 30


def test_hundred_syncs_leave_few_folders(spark, table):
    ads = spark.createDataFrame([(1, 1, 10), (2, 2, 20)], "id long, tenant_id int, campaign_id long")
    shown = [(i, 1 + i % 2, 1 + i % 2, i, "1.0", datetime(2024, 1, 1 + i // 4, 1, i)) for i in range(12)]
    every = spark.createDataFrame(shown, "id long, tenant_id int, ad_id long, user_id long, "
                                  "cost string, timestamp timestamp").withColumn(
        "cost", F.col("cost").cast("decimal(10,4)"))
    now = datetime(2024, 1, 5)
    for upto in range(1, 13):
        said = warehouse.sync_published(spark, every.filter(F.col("id") < upto), ads, table, now)
        assert said["synced_rows"] == 1
    assert warehouse.sync_published(spark, every, ads, table, now)["status"] == "no_new_data"
    expected = sorted(map(tuple, warehouse.read_copy(spark, table).collect()))
    done = warehouse.compact_copy(spark, table, date(2024, 1, 3))
    days = [p.day for p in done.parts]
    assert len(expected) == 12 and days.count("2024-01-01") == 1 and days.count("2024-01-03") == 4
    assert sorted(map(tuple, warehouse.read_copy(spark, table).collect())) == expected
    assert warehouse.sync_published(spark, every, ads, table, now)["status"] == "no_new_data"

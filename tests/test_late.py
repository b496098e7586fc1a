"""Late rows, panes, sketches, changing lookups and state tables of streams."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adlumen.operators import live as batch_live
from adlumen.operators.warehouse import compact_copy, read_copy
from adlumen.sources import versions
from adlumen.streaming import late, live, sinks
from tests.tables import campaigns

EVENT = ("event_id long, event_type string, tenant_id int, campaign_id long, ad_id long, user_id long, "
         "cost decimal(10,4), timestamp timestamp")


def shown(spark, rows):
    """(id, campaign, user, cost, time)"""
    return spark.createDataFrame(
        [(i, "impression_created", 1, c, c, u, cost, at) for i, c, u, cost, at in rows],
        EVENT.replace("decimal(10,4)", "string")).withColumn("cost", F.col("cost").cast("decimal(10,4)"))


def put(spark, rows, path):
    shown(spark, rows).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def at(minutes):
    return datetime(2024, 3, 1, 10) + timedelta(minutes=minutes)


def batches(seed, count=4):
    draw = random.Random(seed)
    ids = iter(range(10**6))
    for n in range(count):
        yield [(next(ids), draw.choice([5, 6]), draw.randrange(9), "0.5000",
                at(120 * n + draw.randrange(120) - draw.choice([0, 0, 0, 130 * min(n, 1)])))
               for _ in range(60)]


def landed(spark, tmp_path, data):
    source, path = str(tmp_path / "in"), str(tmp_path / "landed")
    for rows in data:
        put(spark, rows, source)
        drain(late.land_events(stream(spark, source), path, str(tmp_path / "c")))
    return path, shown(spark, []).schema


def test_late_rows_are_set_aside_by_the_batches_before(spark, tmp_path):
    data = [[(1, 5, 1, "1", at(0)), (2, 5, 1, "1", at(60))],
            [(3, 5, 1, "1", at(50)), (4, 5, 1, "1", at(49)), (5, 5, 1, "1", at(90)), (6, 5, 1, "1", at(70))]]
    path, schema = landed(spark, tmp_path, data)
    assert {r.event_id for r in late.landed(spark, path, schema, True).collect()} == {4}
    assert {r.event_id for r in late.landed(spark, path, schema).collect()} == {1, 2, 3, 4, 5, 6}
    assert late.landed(spark, str(tmp_path / "none"), schema).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_are_repaired_to_the_batch_meaning(spark, tmp_path, seed):
    path, schema = landed(spark, tmp_path, batches(seed))
    out = str(tmp_path / "panes")
    drain(sinks.rows_to_files(live.stream_user_panes(late.rows_in_time(spark, path, schema)), out,
                              str(tmp_path / "p")))
    panes = spark.read.parquet(out)
    every, behind = late.landed(spark, path, schema), late.landed(spark, path, schema, True)
    assert behind.count() > 10
    repaired = late.repaired_windows(panes, every, behind, live.stream_user_panes,
                                     ["tenant_id", "campaign_id", "user_id"], "pane_start",
                                     timedelta(minutes=5))
    last = panes.agg(F.max("pane_start")).first()[0]
    expected = live.stream_user_panes(every).filter(F.col("pane_start") <= F.lit(last))
    assert sorted(map(tuple, repaired.collect())) == sorted(map(tuple, expected.collect()))
    # Sliding windows: the report itself repaired, and the same from repaired panes.
    report = live.windows_of_panes(live.stream_user_panes(late.landed(spark, path, schema, False)))
    again = late.repaired_windows(
        report, every, behind, lambda rows: live.windows_of_panes(live.stream_user_panes(rows)),
        ["tenant_id", "campaign_id"], "window_start", timedelta(hours=1), timedelta(minutes=5))
    whole = live.windows_of_panes(live.stream_user_panes(every))
    inside = {(r.window_start, r.campaign_id): tuple(r) for r in whole.collect()}
    found = {(r.window_start, r.campaign_id): tuple(r) for r in again.collect()}
    assert found == inside
    assert late.repaired_windows(report, every, behind.limit(0), live.stream_user_panes,
                                 ["tenant_id"], "window_start", timedelta(hours=1)) is report


def test_days_are_repaired(spark, tmp_path):
    known = campaigns(spark, [(5, 1, "five", "1", "active", "01-01"), (6, 1, "six", "1", "paused", "01-01")])
    day = 24 * 60
    path, schema = landed(spark, tmp_path, [
        [(1, 5, 1, "1", at(0)), (2, 6, 2, "1", at(1))], [(3, 5, 1, "1", at(2 * day))],
        [(4, 5, 9, "2", at(3)), (5, 6, 9, "2", at(4))]])

    def report(rows):
        return live.stream_dashboard(rows, known, exact=True)

    every = late.landed(spark, path, schema)
    first = report(late.landed(spark, path, schema, False))
    fixed = late.repaired_windows(first, every, late.landed(spark, path, schema, True), report,
                                  ["tenant_id"], "date", timedelta(days=1))
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, report(every).collect()))
    assert {tuple(r)[2] for r in fixed.collect()} == {2, 1}


def test_an_ad_added_after_the_start_is_found(spark, tmp_path):
    source, table, ads_path = (str(tmp_path / n) for n in ("in", "copy", "ads"))
    rows = [(k, 5 + k % 2, 1, "1", at(k)) for k in range(10)]

    def ads(*data):
        spark.createDataFrame(data, "id long, tenant_id int, campaign_id long").write.mode(
            "append").parquet(ads_path)

    def run(part):
        put(spark, part, source)
        arriving = stream(spark, source).withColumnRenamed("event_id", "id")
        drain(sinks.stream_sync_published(arriving, lambda: spark.read.parquet(ads_path), table,
                                          str(tmp_path / "c")))

    ads((5, 1, 50))
    run(rows[:5])
    assert {r.campaign_id for r in read_copy(spark, table).collect()} == {50}
    ads((6, 1, 60))
    run(rows[5:])
    assert sorted(r.campaign_id for r in read_copy(spark, table).collect()) == [50] * 5 + [60] * 3
    # A message that comes days late lands in its own day.
    run([(99, 5, 1, "1", at(-4000))])
    assert read_copy(spark, table).filter(F.col("timestamp") == F.lit(at(-4000))).count() == 1
    number = versions.current(spark, table)
    compact_copy(spark, table, date(2024, 3, 2))
    assert versions.current(spark, table).note == number.note
    assert read_copy(spark, table).count() == 9


def test_state_stays_short_and_right(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "state")
    keys = ("tenant_id", "campaign_id")
    rows = []
    for turn in range(7):
        part = [(turn * 10 + k, 5 + k % 3, 1, "1", at(turn)) for k in range(3 if turn % 2 else 1)]
        rows += part
        put(spark, part, source)
    counts = live.stream_running_counts(stream(spark, source))
    drain(sinks.state_to_versions(counts, table, str(tmp_path / "c"), *keys, fold_every=3, keep=2))
    now = versions.current(spark, table)
    assert now.number == 7 and len(now.parts) <= 3
    assert len(versions._names(spark, f"{table}/data")) <= 5
    found = sinks.latest_state(spark, table, counts.schema, *keys)
    expected = live.stream_running_counts(shown(spark, rows))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_sketches_merge_and_stay_within_their_error(spark):
    rows = spark.range(200_000).select(
        F.lit(1).alias("tenant_id"), (F.col("id") * 7919 % 60_000).alias("user_id"),
        (F.lit(datetime(2024, 3, 1)) + F.make_dt_interval((F.col("id") % 5).cast("int"))).alias("timestamp"))
    early, more = rows.filter("user_id < 30000"), rows.filter("user_id >= 20000")
    stored = batch_live.user_sketches(early).unionByName(batch_live.user_sketches(more))
    found = batch_live.merged_users(stored, ["tenant_id"]).first()
    assert abs(found.unique_users - 60_000) <= 0.03 * 60_000
    assert found.impressions == early.count() + more.count()
    one = batch_live.merged_users(stored, [], date(2024, 3, 2), date(2024, 3, 3)).first()
    exact = rows.filter("day(timestamp) in (2, 3)").select("user_id").distinct().count()
    assert abs(one.unique_users - exact) <= 0.03 * exact

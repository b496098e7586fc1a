"""Streams over hand-made message files; end states against the batch meaning."""

import json
import os
from datetime import datetime

from adlumen.sources.topics import decoded, file_messages, topic_of
from adlumen.streaming import ingest, live, sinks
from tests.tables import campaigns, rows_of

I, C = "impression_created", "click_registered"


def message(event_id, kind, campaign, when, user=None, cost=None, tenant=1):
    return {"event_id": event_id, "event_type": kind, "tenant_id": tenant, "campaign_id": campaign,
            "user_id": user, "cost": cost, "timestamp": f"2024-03-01 {when}"}


def drop(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    text = "\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)
    (folder / name).write_text(text + "\n")
    # The file source takes files in order of modification.
    moment = 1_700_000_000 + ord(name)
    os.utime(folder / name, (moment, moment))


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def run(spark, stream, tmp_path, name="out"):
    out = str(tmp_path / name)
    drain(sinks.rows_to_files(stream, out, str(tmp_path / f"{name}-checkpoint")))
    return spark.read.schema(stream.schema).parquet(out)


def events(spark, tmp_path, files_per_batch=1):
    return ingest.stream_ingest_events(file_messages(spark, str(tmp_path / "in"), files_per_batch))


def test_malformed_and_unknown_messages_are_dropped(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", 7, "0.5"), "not json", "{}",
         message(2, "conversion_tracked", 5, "10:00:00"),
         {"event_type": I, "tenant_id": 1, "campaign_id": 5, "timestamp": "2024-03-01T10:00:00",
          "data": {"user_id": 9, "cost": "0.25", "placement": "top"}})
    found = run(spark, events(spark, tmp_path), tmp_path)
    assert sorted(rows_of(found, "campaign_id", "user_id", "cost", "timestamp")) == [
        (5, 7, 0.5, datetime(2024, 3, 1, 10)), (5, 9, 0.25, datetime(2024, 3, 1, 10))]


def test_tenants_subscribe_apart(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00"), message(2, I, 5, "10:00:00", tenant=2))
    stream = ingest.stream_ingest_events(file_messages(spark, str(tmp_path / "in")), tenant_id=2)
    assert rows_of(run(spark, stream, tmp_path), "event_id") == [(2,)]


def test_duplicates_across_files_count_once(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00"), message(2, I, 5, "10:01:00"))
    drop(tmp_path / "in", "b", message(1, I, 5, "10:00:00"), message(3, I, 5, "10:02:00"))
    found = run(spark, ingest.stream_dedup_events(events(spark, tmp_path)), tmp_path)
    assert sorted(rows_of(found, "event_id")) == [(1,), (2,), (3,)]


def test_running_counts_over_batches(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", cost="0.5"), message(2, C, 5, "10:01:00"),
         message(3, I, 6, "10:00:00", cost="1"))
    drop(tmp_path / "in", "b", message(4, I, 5, "09:00:00", cost="0.25"))
    counts = live.stream_running_counts(events(spark, tmp_path))
    out = str(tmp_path / "out")
    drain(sinks.changes_to_files(counts, out, str(tmp_path / "checkpoint")))
    assert spark.read.parquet(out).count() == 3    # campaign 6 changed only once
    state = sinks.latest_rows(spark, out, counts.schema, "tenant_id", "campaign_id")
    assert sorted(rows_of(state)) == [
        (1, 5, 2, 1, 0.75, datetime(2024, 3, 1, 10, 1)), (1, 6, 1, 0, 1.0, datetime(2024, 3, 1, 10))]
    # Started again on more files, the stream goes on from its checkpoint.
    drop(tmp_path / "in", "c", message(5, C, 6, "10:05:00"))
    drain(sinks.changes_to_files(live.stream_running_counts(events(spark, tmp_path)), out,
                                 str(tmp_path / "checkpoint")))
    state = sinks.latest_rows(spark, out, counts.schema, "tenant_id", "campaign_id")
    assert sorted(rows_of(state, "campaign_id", "impressions", "clicks")) == [(5, 2, 1), (6, 1, 1)]


def test_late_rows_inside_and_outside_the_watermark(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", 7, "1"), message(2, I, 5, "12:00:00", 7, "1"))
    drop(tmp_path / "in", "b", message(3, I, 5, "11:55:00", 8, "1"))    # five minutes late: counts
    # Chained aggregations drop by the watermark of the batch before the last one.
    drop(tmp_path / "in", "c", message(4, I, 5, "10:01:00", 8, "1"))    # two hours late: dropped
    drop(tmp_path / "in", "d", message(5, I, 5, "23:00:00", 9, "1"))    # closes the windows
    drop(tmp_path / "in", "e", message(6, I, 5, "23:00:01", 9, "1"))
    stream = live.stream_live_metrics(events(spark, tmp_path), "1 hour", "1 hour", exact=True)
    found = run(spark, stream, tmp_path)
    assert sorted(rows_of(found, "window_start", "impressions_last_hour", "unique_users",
                          "total_spend", "frequency")) == [
        (datetime(2024, 3, 1, 10), 1, 1, 1.0, 1.0),
        (datetime(2024, 3, 1, 11), 1, 1, 1.0, 1.0),
        (datetime(2024, 3, 1, 12), 1, 1, 1.0, 1.0)]


def test_approximate_users_in_update_mode(spark, tmp_path):
    drop(tmp_path / "in", "a", *[message(i, I, 5, "10:00:00", i % 3, "1") for i in range(9)])
    stream = live.stream_live_metrics(events(spark, tmp_path), "1 hour", "1 hour")
    out = str(tmp_path / "out")
    drain(sinks.changes_to_files(stream, out, str(tmp_path / "checkpoint")))
    assert rows_of(spark.read.parquet(out), "impressions_last_hour", "unique_users",
                   "frequency") == [(9, 3, 3.0)]


def test_dashboard_with_zero_rows(spark, tmp_path):
    known = campaigns(spark, [(5, 1, "five", "1", "active", "02-01"),
                              (6, 1, "six", "1", "paused", "02-01"),
                              (7, 2, "seven", "1", "active", "02-01")])
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", 7, "1"), message(2, I, 6, "10:00:00", 8, "1"))
    stream = live.stream_dashboard(events(spark, tmp_path), known)
    out = str(tmp_path / "out")
    drain(sinks.changes_to_files(stream, out, str(tmp_path / "checkpoint")))
    state = sinks.latest_rows(spark, out, stream.schema, "tenant_id", "date")
    found = live.with_active_campaigns(state.filter("date = '2024-03-01'"), known)
    assert sorted(rows_of(found, "tenant_id", "active_campaigns", "impressions_today", "spend_today",
                          "unique_users_today")) == [(1, 1, 1, 1.0, 1), (2, 1, 0, 0.0, 0)]


def test_snapshots_carry_the_batch_time(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", 7, "1"))
    out = str(tmp_path / "out")
    drain(sinks.stream_metric_snapshot(events(spark, tmp_path), out, str(tmp_path / "checkpoint")))
    row = spark.read.parquet(out).first()
    assert (row["impressions"], row["clicks"], float(row["spend"])) == (1, 0, 1.0)
    assert row["timestamp"].year >= 2024


def test_publish_writes_one_folder_per_topic(spark, tmp_path):
    drop(tmp_path / "in", "a", message(1, I, 5, "10:00:00", 7, "1.5"), message(2, C, 5, "10:00:00"),
         message(3, I, 5, "10:00:00", tenant=2))
    out = tmp_path / "topics"
    drain(ingest.publish_to_files(events(spark, tmp_path), str(out), str(tmp_path / "checkpoint")))
    assert {p.name for p in out.iterdir() if p.name.startswith("topic=")} == {
        "topic=impressions-tenant-1", "topic=impressions-tenant-2", "topic=clicks-tenant-1"}
    assert topic_of(C, 1) == "clicks-tenant-1"
    text = spark.read.text(str(out / "topic=impressions-tenant-1"))
    assert json.loads(text.first()[0])["cost"] == "1.5000"
    assert rows_of(decoded(text), "event_id", "cost") == [(1, 1.5)]


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    from adlumen.streaming import sinks

    path = str(tmp_path / "changes")
    for batch, rows in enumerate([[(1, 10), (2, 20)], [(1, 11)], [(3, 30)], [(2, 21)]]):
        spark.createDataFrame(rows, "k int, v int").selectExpr("*", f"{batch}L AS batch").write.mode(
            "append").partitionBy("batch").parquet(path)
    schema = spark.createDataFrame([], "k int, v int").schema

    def newest():
        return sorted(map(tuple, sinks.latest_rows(spark, path, schema, "k").collect()))

    before = newest()
    sinks.compact(spark, path, schema, "k", below=3)
    assert newest() == before == [(1, 11), (2, 21), (3, 30)]
    assert spark.read.parquet(path).select("batch").distinct().count() == 2

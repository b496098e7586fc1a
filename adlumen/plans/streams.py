"""The streaming operators run over the events table until it is used up."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from adlumen.operators.warehouse import compact_copy, read_copy
from adlumen.plans import facts
from adlumen.session import settle, shared_folder
from adlumen.sources.topics import file_messages
from adlumen.streaming import ingest, late, live, sinks


def _fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folders of one run, kept because results are read lazily."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _drain(writer: DataStreamWriter) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Views and clicks as a stream of live events."""
    source = spark.readStream.schema(facts.SCHEMAS["events"])
    rows = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    return facts.live_events(rows)


def published(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = _fresh(spark, "publish")
    _drain(ingest.publish_to_files(event_messages(spark, folder), out, checkpoint))
    return spark.read.schema("value STRING, topic STRING").text(out)


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """Publish to files, then subscribe to those files."""
    topics, checkpoint = _fresh(spark, "publish")
    _drain(ingest.publish_to_files(event_messages(spark, folder), topics, checkpoint))
    out, checkpoint = _fresh(spark, "ingest")
    events = ingest.stream_ingest_events(file_messages(spark, topics))
    _drain(sinks.rows_to_files(events, out, checkpoint))
    return spark.read.schema(events.schema).parquet(out).drop("ad_id", "impression_id")


def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = _fresh(spark, "counts")
    counts = live.stream_running_counts(event_messages(spark, folder))
    _drain(sinks.changes_to_files(counts, out, checkpoint))
    return sinks.latest_rows(spark, out, counts.schema, "tenant_id", "campaign_id")


def running_counts_published(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from several batches, kept short by the writer and read by version."""
    base = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    _in_two_files(spark, facts.table(spark, folder, "events"),
                  F.to_date("ts") <= F.lit(facts.EVENT_DAY.isoformat()).cast("date"),
                  f"{base}/messages")
    counts = live.stream_running_counts(_file_by_file(spark, f"{base}/messages"))
    keys = ("tenant_id", "campaign_id")
    _drain(sinks.state_to_versions(counts, f"{base}/state", f"{base}/checkpoint", *keys,
                                   fold_every=2, keep=1))
    return sinks.latest_state(spark, f"{base}/state", counts.schema, *keys)


def _in_two_files(spark: SparkSession, rows: DataFrame, first: Column, path: str) -> None:
    """Rows for which ``first`` holds as a message file, then the others as one."""
    for part in (rows.filter(first), rows.filter(~first)):
        part.coalesce(1).write.mode("append").parquet(path)


def _file_by_file(spark: SparkSession, path: str) -> DataFrame:
    """Live events of the message files, a batch for each."""
    messages = spark.readStream.schema(facts.SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
    return facts.live_events(messages.parquet(path))


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Every event delivered twice and counted once."""
    out, checkpoint = _fresh(spark, "dedup")
    events = event_messages(spark, folder)
    once = ingest.stream_dedup_events(events.unionByName(events))
    _drain(sinks.rows_to_files(once, out, checkpoint))
    return spark.read.schema(once.schema).parquet(out)


def _newest(query: StreamingQuery) -> datetime | None:
    """The newest event time the stream has met, from its own progress."""
    times = [p.eventTime["max"] for p in query.recentProgress if "max" in p.eventTime]
    return max(map(datetime.fromisoformat, times), default=None)


def _with_open_windows(spark: SparkSession, name: str, stream: DataFrame, events: DataFrame,
                       report: Callable[[DataFrame], DataFrame], reach: timedelta, start: str,
                       *keys: str) -> DataFrame:
    """What the stream has closed, and the windows still open from the same report as a batch.

    Open windows end after the watermark, so they begin within ``reach`` before
    it: of the events and of the closed windows no more than that is read.
    """
    out, checkpoint = _fresh(spark, name)
    rows = report(stream)
    newest = _newest(_drain(sinks.rows_to_files(rows, out, checkpoint)))
    if newest is None:
        return spark.createDataFrame([], rows.schema)
    closed = spark.read.schema(rows.schema).parquet(out)
    # A minute more than the ten of the watermark.
    first = newest - reach - timedelta(minutes=11)
    recent = report(events.filter(F.col("timestamp") >= F.lit(first)))
    near = closed.filter(F.col(start) >= F.lit(first - reach).cast(rows.schema[start].dataType))
    still_open = recent.join(near, [start, *keys], "left_anti")
    return closed.unionByName(still_open)


_PANE = ("pane_start", "tenant_id", "campaign_id", "user_id")


def _live_batch(spark: SparkSession, folder: str) -> DataFrame:
    return facts.live_events(facts.table(spark, folder, "events"))


def live_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every sliding window, from the panes that a stream keeps."""
    panes = _with_open_windows(
        spark, "live", event_messages(spark, folder), _live_batch(spark, folder),
        live.stream_user_panes, timedelta(minutes=5), *_PANE)
    return live.windows_of_panes(panes)


def live_metrics_chained(spark: SparkSession, folder: str) -> DataFrame:
    """The same windows closed by the stream itself, in chained states."""
    return _with_open_windows(
        spark, "live", event_messages(spark, folder), _live_batch(spark, folder),
        lambda events: live.stream_live_metrics(events, exact=True),
        timedelta(hours=1), "window_start", "tenant_id", "campaign_id")


def _landed_late(spark: SparkSession, folder: str) -> tuple[str, T.StructType]:
    """The events as they arrive when every tenth is delivered after all the others."""
    base = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    _in_two_files(spark, facts.table(spark, folder, "events"), F.col("event_id") % 10 != 3,
                  f"{base}/messages")
    events = _file_by_file(spark, f"{base}/messages")
    _drain(late.land_events(events, f"{base}/landed", f"{base}/checkpoint"))
    return f"{base}/landed", events.schema


def live_metrics_late(spark: SparkSession, folder: str) -> DataFrame:
    """Late events put into their panes, then every sliding window."""
    path, schema = _landed_late(spark, folder)
    panes = _with_open_windows(
        spark, "live", late.rows_in_time(spark, path, schema), late.landed(spark, path, schema, False),
        live.stream_user_panes, timedelta(minutes=5), *_PANE)
    return live.windows_of_panes(late.repaired_windows(
        panes, late.landed(spark, path, schema), late.landed(spark, path, schema, True),
        live.stream_user_panes, list(_PANE[1:]), "pane_start", timedelta(minutes=5)))


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """Every day of every tenant, idle ones with zeros."""
    known = facts.campaigns(spark, folder)
    totals = _with_open_windows(
        spark, "dashboard", event_messages(spark, folder), _live_batch(spark, folder),
        lambda events: live.stream_dashboard(events, known, exact=True),
        timedelta(days=1), "date", "tenant_id")
    return _all_days(spark, folder, totals)


def dashboard_late(spark: SparkSession, folder: str) -> DataFrame:
    """The same when late events have reached days that were closed."""
    known = facts.campaigns(spark, folder)
    path, schema = _landed_late(spark, folder)

    def report(events: DataFrame) -> DataFrame:
        return live.stream_dashboard(events, known, exact=True)

    totals = _with_open_windows(
        spark, "dashboard", late.rows_in_time(spark, path, schema),
        late.landed(spark, path, schema, False), report, timedelta(days=1), "date", "tenant_id")
    return _all_days(spark, folder, late.repaired_windows(
        totals, late.landed(spark, path, schema), late.landed(spark, path, schema, True), report,
        ["tenant_id"], "date", timedelta(days=1)))


def _all_days(spark: SparkSession, folder: str, totals: DataFrame) -> DataFrame:
    totals = settle(totals)
    first, last = totals.agg(F.min("date"), F.max("date")).first()
    days = [first + timedelta(n) for n in range((last - first).days + 1)] if first else []
    return live.with_active_campaigns(totals, facts.campaigns(spark, folder), days,
                                      facts.tenants(spark, folder))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot of each campaign, over however many batches there were."""
    out, checkpoint = _fresh(spark, "snapshots")
    _drain(sinks.stream_metric_snapshot(event_messages(spark, folder), out, checkpoint))
    schema = spark.read.parquet(out).drop("batch").schema
    return sinks.latest_rows(spark, out, schema, "tenant_id", "campaign_id").drop("timestamp")


def synced(spark: SparkSession, folder: str) -> DataFrame:
    out, checkpoint = _fresh(spark, "sync")
    shown = event_messages(spark, folder).filter(F.col("event_type") == "impression_created")
    rows = shown.withColumnRenamed("event_id", "id")
    _drain(sinks.stream_sync(rows, facts.ads(spark, folder), out, checkpoint))
    return spark.read.parquet(out)


def synced_published(spark: SparkSession, folder: str) -> DataFrame:
    """The copy kept by a stream in several batches and compacted, read by its newest version."""
    base = f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    _in_two_files(spark, facts.table(spark, folder, "events"),
                  F.to_date("ts") <= F.lit(facts.EVENT_DAY.isoformat()).cast("date"),
                  f"{base}/messages")
    shown = _file_by_file(spark, f"{base}/messages").filter(
        F.col("event_type") == "impression_created")
    _drain(sinks.stream_sync_published(
        shown.withColumnRenamed("event_id", "id"), lambda: facts.ads(spark, folder),
        f"{base}/copy", f"{base}/checkpoint"))
    compact_copy(spark, f"{base}/copy", facts.EVENT_NOON.date())
    return read_copy(spark, f"{base}/copy")

"""Every operator as a query over the driver's tables, all tenants at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.functions.scope import date_range_filter
from adlumen.operators import attribution as attr
from adlumen.operators import (
    catalog, cohort, eventlog, jobs, live, page, performance, validate, warehouse,
)
from adlumen.plans import facts, streams
from adlumen.plans.facts import EVENT_DAY, EVENT_NOON, VOLUME_DAY, VOLUME_NOW
from adlumen.session import settle, shared_folder
from adlumen.sources import versions
from adlumen.sources.tables import overwrite_days

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Types that any SQL engine shares: BIGINT, DOUBLE, zone-free TIMESTAMP."""
    columns = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            value = value.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            value = value.cast("timestamp_ntz")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _on_volume(operator: Callable[..., DataFrame], **options) -> Query:
    """Query of an operator that takes campaigns, ads and impressions."""
    return lambda spark, sf: operator(
        facts.campaigns(spark, sf), facts.ads(spark, sf), facts.volume_impressions(spark, sf),
        **options,
    )


def _on_events(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf: operator(
        facts.campaigns(spark, sf), facts.ads(spark, sf), facts.impressions(spark, sf), **options
    )


def _attribution(mode: str) -> Query:
    return lambda spark, sf: attr.attribution(
        facts.impressions(spark, sf), facts.ads(spark, sf), facts.clicks(spark, sf),
        facts.conversions(spark, sf), mode=mode,
    )


def _page(kind: str) -> Query:
    """All parts of tenant 1's page as labelled rows with an item and three figures."""
    figures = {
        "cohort_data": ("period_days", "users", "total_impressions", "retention_rate"),
        "cohort_analysis": ("period_days", "users", "total_impressions", "retention_rate"),
        "top_campaigns": ("id", "total_impressions", "total_spend", "avg_cpm"),
        "totals": (None, "total_events", "total_impression_events", "total_impressions"),
        "realtime_metrics": (None, "impressions_last_hour", "spend_last_hour", "frequency"),
        "performance_metrics": ("campaign_id", "impressions", "total_cost", "unique_users"),
    }
    days = {"cohort_data": "cohort_month", "cohort_analysis": "cohort_month",
            "performance_metrics": "date"}

    def query(spark: SparkSession, sf: str) -> DataFrame:
        parts = page.dashboard_bundle(
            facts.campaigns(spark, sf), facts.ads(spark, sf), facts.impressions(spark, sf),
            facts.log(spark, sf), 1, EVENT_NOON, kind)
        rows = []
        for part, frame in parts.items():
            item, *values = figures[part]
            day = F.col(days[part]) if part in days else F.lit(None).cast("date")
            rows.append(frame.select(
                F.lit(part).alias("part"), day.alias("day"),
                (F.col(item) if item else F.lit(None)).cast("bigint").alias("item"),
                *[F.col(v).cast("double").alias(n) for v, n in zip(values, "abc")]))
        return reduce(DataFrame.unionByName, rows)

    return query


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Users of each tenant over all days from daily sketches, against the exact number."""
    shown = facts.impressions(spark, sf)
    merged = live.merged_users(live.user_sketches(shown), ["tenant_id"])
    exact = shown.groupBy("tenant_id").agg(F.countDistinct("user_id").alias("exact_users"))
    error = F.abs(F.col("unique_users") - F.col("exact_users"))
    return merged.join(exact, "tenant_id").select(
        "tenant_id", "impressions", "exact_users",
        (error <= F.col("exact_users") * 0.03).alias("within_bound"))


def _query_log(spark: SparkSession, sf: str) -> DataFrame:
    return facts.table(spark, sf, "events").select(
        F.col("value").cast("decimal(12,2)").alias("seconds")
    )


def _batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to look up: those of the error events, which the log lacks, and of all others."""
    return facts.table(spark, sf, "events").select("event_id")


def _daily_upsert(spark: SparkSession, sf: str) -> DataFrame:
    fresh = jobs.daily_metrics(
        facts.campaigns(spark, sf), facts.ads(spark, sf), facts.volume_impressions(spark, sf),
        day=VOLUME_DAY,
    )
    return jobs.daily_metrics_upsert(facts.stored_metrics(spark, sf), fresh)


def _appended(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log in two batches: what was up to a day, and what came after it."""
    number = ["id", "tenant_id", "aggregate_id", "event_type", "timestamp", "sequence_number"]
    every = facts.log(spark, sf)
    early = F.to_date("timestamp") <= F.lit(EVENT_DAY.isoformat()).cast("date")
    stored = eventlog.append_events(every.filter(early))
    last = settle(eventlog.last_sequences(stored))
    new = eventlog.append_events(every.filter(~early), last=last)
    return stored.unionByName(new).select(*number)


def _stored_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The upsert of a day as a table on disk, read back."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    stored = eventlog.event_replay(facts.log(spark, sf)).drop("unique_users")
    overwrite_days(stored.select(*[F.col(f.name).cast(f.dataType) for f in jobs.METRICS.fields
                                   if f.name in stored.columns]), path)
    fresh = jobs.daily_metrics(
        facts.campaigns(spark, sf), facts.ads(spark, sf), facts.impressions(spark, sf),
        day=EVENT_DAY)
    jobs.upsert_day(spark, path, fresh, EVENT_DAY)
    return spark.read.schema(jobs.METRICS).parquet(path).select(*stored.columns)


def _stored_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The copy of one tenant made in two batches with its mark, read back."""
    base = f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}"
    every = facts.impressions(spark, sf).filter("tenant_id = 1")
    early = every.filter(F.to_date("timestamp") <= F.lit(EVENT_DAY.isoformat()).cast("date"))
    for rows in (early, every):
        warehouse.sync_to_warehouse(spark, rows, facts.ads(spark, sf), f"{base}/copy",
                                    f"{base}/marks", 1, as_of=EVENT_NOON, days_back=3650)
    return spark.read.parquet(f"{base}/copy").drop("batch", "date")


def _published_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The copy of all tenants made in two batches, closed days compacted, read by version."""
    table = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    every = facts.impressions(spark, sf)
    early = every.filter(F.to_date("timestamp") <= F.lit(EVENT_DAY.isoformat()).cast("date"))
    for rows in (early, every):
        warehouse.sync_published(spark, rows, facts.ads(spark, sf), table, EVENT_NOON, 3650)
    warehouse.compact_copy(spark, table, EVENT_NOON.date())
    return warehouse.read_copy(spark, table).drop("date")


def _published_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Stored metrics published once, rebuilt from the log, read through the newest version."""
    table = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    versions.publish(spark, table, facts.kept_metrics(spark, sf).select(
        *[F.col(f.name).cast(f.dataType) for f in jobs.METRICS.fields]), versions.NONE)
    jobs.replay_into(spark, table, facts.log(spark, sf))
    return versions.read_version(spark, table, jobs.METRICS)


def _reserved(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log by two writers, events with odd and with even ids, one table of numbers."""
    table = f"{shared_folder(spark)}/numbers-{uuid.uuid4().hex}"
    every = facts.log(spark, sf)
    halves = [eventlog.append_reserved(spark, every.filter(F.col("id") % 2 == rest), table, name)
              for name, rest in (("odd", 1), ("even", 0))]
    return halves[0].unionByName(halves[1]).drop("payload")


def _rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.rebuild_metrics(facts.stored_metrics(spark, sf), facts.log(spark, sf))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    part = facts.table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("tenant_id"),
        F.col("p_name").alias("name"),
    )


def _budget_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as campaigns of their supplier, with its balance as monthly budget."""
    rows = facts.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(1).alias("tenant_id"),
        F.col("l_suppkey").alias("advertiser_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("budget"),
    )
    caps = facts.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit(1).alias("tenant_id"),
        F.col("s_suppkey").alias("advertiser_id"),
        (F.col("s_acctbal").cast("decimal(12,2)") * 5).cast("decimal(14,2)")
        .alias("monthly_budget"),
    )
    checked = validate.v_budget_cap(rows, caps)
    return _error_counts(checked, "advertiser_id")


def _error_counts(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.groupBy(*keys, F.array_join("errors", "; ").alias("errors")).agg(
        F.count("*").alias("rows")
    )


def _orders_as_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as campaigns: status by order status, previous one by priority."""
    now = F.col("o_orderstatus")
    before = F.col("o_orderpriority")
    return facts.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(now == "F", "active").when(now == "O", "paused").otherwise("stopped")
        .alias("status"),
        F.when(before.startswith("1"), "draft").when(before.startswith("2"), "active")
        .when(before.startswith("3"), "paused").when(before.startswith("4"), "stopped")
        .otherwise("completed").alias("before"),
        F.to_date("o_orderdate").alias("start_date"), "o_custkey",
        F.concat(before, F.lit(" / "), now).alias("label"), "o_totalprice",
    )


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders_as_campaigns(spark, sf)
    stored = rows.select("id", F.col("before").alias("status"))
    return _error_counts(validate.v_status_transition(rows.drop("before"), stored), "status")


def _date_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ship date against order date, as end and start of a campaign."""
    items = facts.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("end_date")
    )
    rows = items.join(_orders_as_campaigns(spark, sf).select("id", "start_date"), "id")
    return _error_counts(validate.v_date_order(rows), "start_date")


def _required(kind: str) -> Query:
    """Views, clicks or purchases as reported; those with user 0 or ad 0 count as lacking it."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = facts.reported(spark, sf, kind)
        checked = validate.v_required_fields(rows, kind)
        return checked.select("id", F.array_join("errors", "; ").alias("errors"))

    return query


def _schema(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a name that grows with the customer number and the price as budget."""
    rows = _orders_as_campaigns(spark, sf).select(
        "id",
        F.repeat(F.lit("x"), F.pmod("o_custkey", F.lit(120)).cast("int")).alias("name"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice").cast("decimal(12,2)")
               .cast("string"))
        .when(F.col("o_custkey") % 3 == 1, F.lit("12.345")).otherwise(F.lit("n/a"))
        .alias("budget"),
        F.when(F.col("status") == "stopped", "archived").otherwise(F.col("status"))
        .alias("status"),
    )
    return _error_counts(validate.v_schema(rows))


QUERIES: dict[str, Query] = {
    # Cohorts
    "cohort_retention": lambda s, sf: cohort.cohort_retention(facts.impressions(s, sf)),
    "cohort_retention_volume": lambda s, sf: cohort.cohort_retention(
        facts.volume_impressions(s, sf)),
    "advanced_cohort": lambda s, sf: cohort.advanced_cohort(
        facts.impressions(s, sf), days_back=20, as_of=EVENT_NOON),
    "advanced_cohort_non_negative": lambda s, sf: cohort.advanced_cohort(
        facts.impressions(s, sf), days_back=20, as_of=EVENT_NOON, non_negative=True),
    "advanced_cohort_volume": lambda s, sf: cohort.advanced_cohort(
        facts.volume_impressions(s, sf), days_back=1500, as_of=VOLUME_NOW),
    "warehouse_cohort": lambda s, sf: cohort.advanced_cohort(
        facts.warehouse(s, sf), days_back=30, as_of=EVENT_NOON),
    # Performance
    "campaign_daily_performance": _on_volume(performance.campaign_daily_performance),
    "top_campaigns": _on_volume(performance.top_campaigns, limit=5),
    "campaign_ranking": _on_volume(performance.campaign_ranking, as_of=VOLUME_NOW),
    "hourly_trend": lambda s, sf: performance.hourly_trend(
        facts.ads(s, sf), facts.impressions(s, sf), hours_back=240, as_of=EVENT_NOON),
    "warehouse_daily_performance": lambda s, sf: performance.warehouse_daily_performance(
        facts.warehouse(s, sf), as_of=EVENT_NOON, days_back=30),
    "campaign_report": lambda s, sf: performance.campaign_report(
        facts.ads(s, sf), facts.volume_impressions(s, sf)),
    "daily_aggregate": lambda s, sf: performance.daily_aggregate(
        facts.ads(s, sf), facts.volume_impressions(s, sf)),
    "attribution": _attribution("reference"),
    "attribution_per_touch": _attribution("per_touch"),
    # Live figures
    "realtime_metrics": lambda s, sf: live.realtime_metrics(
        facts.impressions(s, sf), facts.ads(s, sf), as_of=EVENT_NOON, hours=24,
        tenants=facts.tenants(s, sf)),
    "campaign_live_metrics": lambda s, sf: live.campaign_live_metrics(
        facts.impressions(s, sf), facts.ads(s, sf), as_of=EVENT_NOON, hours=24,
        campaigns=facts.campaigns(s, sf)),
    "active_campaign_count": lambda s, sf: live.active_campaign_count(
        facts.campaigns(s, sf), tenants=facts.tenants(s, sf)),
    "impressions_on_day": lambda s, sf: live.impressions_on_day(
        facts.volume_impressions(s, sf), day=VOLUME_DAY, tenants=facts.tenants(s, sf)),
    "unique_users_on_day": lambda s, sf: live.unique_users_on_day(
        facts.impressions(s, sf), day=EVENT_DAY, tenants=facts.tenants(s, sf)),
    "unique_users_sketched": _sketched,
    "spend_last_hour": lambda s, sf: live.spend_last_hour(
        facts.impressions(s, sf), as_of=EVENT_NOON, hours=24, tenants=facts.tenants(s, sf)),
    "top_campaign_on_day": _on_events(live.top_campaign_on_day, day=EVENT_DAY),
    "dashboard_totals": lambda s, sf: live.dashboard_totals(
        facts.campaigns(s, sf), facts.ads(s, sf), facts.impressions(s, sf), day=EVENT_DAY,
        tenants=facts.tenants(s, sf)),
    "bid_price": lambda s, sf: live.bid_price(
        facts.impressions(s, sf), as_of=EVENT_NOON, minutes=24 * 60,
        tenants=facts.tenants(s, sf)),
    "dashboard_bundle": lambda s, sf: live.tenant_totals(
        facts.impressions(s, sf), facts.log(s, sf)),
    "dashboard_realtime": _page("realtime"),
    "dashboard_overview": _page("overview"),
    "dashboard_analysis": _page("analysis"),
    # Stored tables
    "query_log_stats": lambda s, sf: catalog.query_log_stats(_query_log(s, sf)),
    "distinct_campaign_count": _on_volume(catalog.distinct_campaign_count),
    "ads_with_campaign": lambda s, sf: catalog.ads_with_campaign(
        facts.ads(s, sf), facts.campaigns(s, sf)),
    "tenant_table": lambda s, sf: catalog.tenant_table(facts.campaigns(s, sf), tenant_id=2),
    "date_range_filter": lambda s, sf: date_range_filter(
        facts.impressions(s, sf), 1, EVENT_NOON.replace(day=10), EVENT_NOON),
    "tenant_stats": lambda s, sf: catalog.tenant_stats(
        facts.volume_impressions(s, sf), facts.campaigns(s, sf), facts.ads(s, sf)),
    "permission_check": lambda s, sf: catalog.permission_check(
        facts.permission_requests(s, sf), facts.grants(s, sf)),
    "tenant_admins": lambda s, sf: catalog.tenant_admins(facts.users(s, sf)),
    "creative_urls": lambda s, sf: catalog.creative_urls(
        facts.ads(s, sf), "https://cdn.example.com"),
    # Warehouse copy and stored metrics
    "sync_status": lambda s, sf: warehouse.sync_status(
        facts.warehouse(s, sf), tenants=facts.tenants(s, sf)),
    "sync_impressions": lambda s, sf: warehouse.sync_impressions(
        facts.impressions(s, sf), facts.ads(s, sf),
        after=warehouse.Mark(EVENT_NOON.replace(day=5), 0)),
    "sync_stored": _stored_sync,
    "sync_published": _published_sync,
    "daily_metrics_upsert": _daily_upsert,
    "daily_metrics_upsert_stored": _stored_upsert,
    # Event log
    "event_replay": lambda s, sf: eventlog.event_replay(facts.log(s, sf)),
    "event_replay_with_conversions": lambda s, sf: eventlog.event_replay(
        facts.log(s, sf), with_conversions=True),
    "event_totals": lambda s, sf: eventlog.event_totals(facts.log(s, sf)),
    "event_replay_stored": _rebuilt,
    "event_replay_published": _published_replay,
    "append_events": _appended,
    "append_events_reserved": _reserved,
    "log_from_facts": lambda s, sf: eventlog.log_from_facts(
        facts.impression_facts(s, sf), facts.clicks(s, sf), facts.conversions(s, sf)),
    "event_stream": lambda s, sf: eventlog.event_stream(facts.numbered_log(s, sf), limit=20),
    "event_stream_sliced": lambda s, sf: eventlog.event_stream(
        facts.numbered_log(s, sf), limit=40, few=10),
    "audit_trail": lambda s, sf: eventlog.audit_trail(facts.numbered_log(s, sf)),
    "validate_sequence": lambda s, sf: eventlog.sequence_gaps(facts.numbered_log(s, sf)),
    "validate_sequence_summary": lambda s, sf: eventlog.validate_sequence(
        facts.numbered_log(s, sf)),
    "event_stats": lambda s, sf: eventlog.event_stats(facts.log(s, sf), as_of=EVENT_NOON),
    "event_batch_counts": lambda s, sf: eventlog.event_batch_counts(
        facts.log(s, sf), _batch_ids(s, sf)),
    "retention_split": lambda s, sf: eventlog.retention_split(
        facts.log(s, sf), days=10, as_of=EVENT_NOON),
    "retained_events": lambda s, sf: eventlog.retained_events(
        facts.log(s, sf), days=10, as_of=EVENT_NOON).drop("payload"),
    # Table checks
    "v_unique_name": lambda s, sf: validate.v_unique_name(_names(s, sf)).select(
        "id", F.array_join("errors", "; ").alias("errors")),
    "v_budget_cap": _budget_rows,
    "v_date_order": _date_order,
    "v_status_transition": _transitions,
    "v_required_fields": _required("impression"),
    "v_required_fields_click": _required("click"),
    "v_required_fields_conversion": _required("conversion"),
    "v_schema": _schema,
    # Streams
    "stream_publish": streams.published,
    "stream_ingest_events": streams.ingested,
    "stream_dedup_events": streams.deduplicated,
    "stream_running_counts": streams.running_counts,
    "stream_running_counts_published": streams.running_counts_published,
    "stream_live_metrics": streams.live_metrics,
    "stream_live_metrics_chained": streams.live_metrics_chained,
    "stream_live_metrics_late": streams.live_metrics_late,
    "stream_dashboard": streams.dashboard,
    "stream_dashboard_late": streams.dashboard_late,
    "stream_metric_snapshot": streams.snapshots,
    "stream_sync": streams.synced,
    "stream_sync_published": streams.synced_published,
}


def queries() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, folder: comparable(query(spark, folder))

    return {name: prepared(query) for name, query in QUERIES.items()}

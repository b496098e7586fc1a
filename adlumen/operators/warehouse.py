"""The warehouse copy of the impressions: selecting, copying and describing it."""

from __future__ import annotations

from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.functions.scope import Moment, by_date, listed, moment, scope, span, tenant_keys
from adlumen.operators.placement import with_campaign
from adlumen.sources import versions
from adlumen.sources.tables import read_mark, write_mark

# What the copy states where the source has no such column.
COUNTRY, DEVICE = "US", "desktop"

# Marks are kept as text in the session's time zone, which is UTC.
MARK_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


class Mark(NamedTuple):
    """The last copied row: rows of the same time are told apart by id."""

    timestamp: datetime
    id: int


def _after(impressions: DataFrame, mark: Mark | None, as_of: Moment, days_back: int) -> DataFrame:
    if mark is None:
        start = moment(impressions, as_of) - span(days=days_back)
        return by_date(impressions.filter(F.col("timestamp") > start), start)
    at = moment(impressions, mark.timestamp)
    # The first bound alone decides for the file scan.
    return by_date(impressions.filter(
        (F.col("timestamp") >= at) & ((F.col("timestamp") > at) | (F.col("id") > mark.id))
    ), at)


def _until(impressions: DataFrame, mark: Mark) -> DataFrame:
    at = moment(impressions, mark.timestamp)
    return by_date(impressions.filter(
        (F.col("timestamp") <= at) & ((F.col("timestamp") < at) | (F.col("id") <= mark.id))
    ), end=at)


def as_warehouse_rows(impressions: DataFrame, ads: DataFrame) -> DataFrame:
    """Impressions in the shape of the copy, with their id for bookkeeping."""
    rows = with_campaign(impressions, ads, "id", "user_id", "cost", "timestamp")
    return rows.select(
        "id", "tenant_id", "campaign_id", "ad_id", "user_id", "cost", "timestamp",
        F.lit(COUNTRY).alias("country"), F.lit(DEVICE).alias("device_type"),
    )


def sync_impressions(impressions: DataFrame, ads: DataFrame, tenant_id: int | None = None,
                     after: Mark | None = None, batch_size: int | None = None,
                     as_of: Moment = None, days_back: int = 30) -> DataFrame:
    """Impressions after the mark, ready for the copy; the last 30 days without one.

    ``batch_size`` takes the oldest that many; by default everything new is
    copied and nothing needs sorting.
    """
    rows = _after(scope(impressions, tenant_id), after, as_of, days_back)
    ready = as_warehouse_rows(rows, ads)
    if batch_size is not None:
        ready = ready.orderBy("timestamp", "id").limit(batch_size)
    return ready.drop("id")


def sync_to_warehouse(spark: SparkSession, impressions: DataFrame, ads: DataFrame, path: str,
                      marks_path: str, tenant_id: int, batch_size: int | None = None,
                      as_of: Moment = None, days_back: int = 30) -> dict:
    """Copy one batch to the Parquet copy at ``path`` and move the tenant's mark.

    The batch is bounded by two marks before any row is written, and its
    folder is named after the starting one. A run that is repeated after a
    failure writes the same rows to the same folder, so nothing is copied twice.
    """
    stored = read_mark(spark, marks_path, tenant_id)
    start = None if stored is None else Mark(datetime.fromisoformat(stored[0]), stored[1])
    fresh = _after(scope(impressions, tenant_id), start, as_of, days_back)
    known = ads.select(F.col("id").alias("ad_id"))
    candidates = fresh.join(known, "ad_id", "left_semi").select("timestamp", "id")
    if batch_size is not None:
        candidates = candidates.orderBy("timestamp", "id").limit(batch_size)
    end_row = candidates.agg(
        F.max(F.struct("timestamp", "id")).alias("top"), F.count("*").alias("rows")
    ).select("rows", F.date_format("top.timestamp", MARK_TIME).alias("at"), "top.id").first()
    if not end_row["rows"]:
        return {"synced_rows": 0, "status": "no_new_data"}
    end = Mark(datetime.fromisoformat(end_row["at"]), end_row["id"])
    label = "begin" if start is None else f"{start.timestamp:%Y%m%dT%H%M%S%f}-{start.id}"
    batch = as_warehouse_rows(_until(fresh, end), ads).drop("id").select(
        "*", F.lit(f"{tenant_id}-{label}").alias("batch"), F.to_date("timestamp").alias("date")
    )
    # Rebalanced by day: AQE splits a day too big for one task.
    batch.hint("rebalance", "date").sortWithinPartitions("date", "timestamp").write.option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch", "date").mode("overwrite").parquet(path)
    write_mark(spark, marks_path, tenant_id, end_row["at"], end.id)
    return {"synced_rows": end_row["rows"], "status": "success", "last_timestamp": end.timestamp}


COPY = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("campaign_id", T.LongType()),
    T.StructField("ad_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("cost", T.DecimalType(10, 4)),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("country", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("date", T.DateType()),
])
COPY_ORDER = ("tenant_id", "timestamp")


def sync_published(spark: SparkSession, impressions: DataFrame, ads: DataFrame, table: str,
                   as_of: Moment = None, days_back: int = 30) -> dict:
    """Copy what is new of all tenants into a published table (``sources.versions``).

    One layout for all tenants, by day, each day's files sorted by tenant and
    time. Rows and mark are published in the same step: a run that fails leaves
    neither, and of two runs at once one fails with ``VersionConflict``. Every
    run adds a folder to each day it has rows of; ``compact_copy`` joins them.
    """
    base = versions.current(spark, table)
    start = None
    if base.note:
        at, row_id = base.note.split("|")
        start = Mark(datetime.fromisoformat(at), int(row_id))
    known = ads.select(F.col("id").alias("ad_id"))
    fresh = _after(impressions, start, as_of, days_back)
    end_row = fresh.join(known, "ad_id", "left_semi").agg(
        F.max(F.struct("timestamp", "id")).alias("top"), F.count("*").alias("rows")
    ).select("rows", F.date_format("top.timestamp", MARK_TIME).alias("at"), "top.id").first()
    if not end_row["rows"]:
        return {"synced_rows": 0, "status": "no_new_data"}
    end = Mark(datetime.fromisoformat(end_row["at"]), end_row["id"])
    batch = as_warehouse_rows(_until(fresh, end), ads).withColumn("date", F.to_date("timestamp"))
    rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in COPY.fields])
    versions.publish(spark, table, rows, base, (), f"{end_row['at']}|{end.id}", COPY_ORDER)
    return {"synced_rows": end_row["rows"], "status": "success", "last_timestamp": end.timestamp}


def compact_copy(spark: SparkSession, table: str, before: date) -> versions.Version:
    """One folder for each closed day of the copy; readers at work are not disturbed."""
    return versions.compact(spark, table, COPY, before, order=COPY_ORDER)


def read_copy(spark: SparkSession, table: str) -> DataFrame:
    """The copy as of its newest version."""
    return versions.read_version(spark, table, COPY)


def sync_status(facts: DataFrame, tenant_id: int | None = None,
                tenants: DataFrame | None = None) -> DataFrame:
    """Rows, campaigns and time range of the copy; status no_data while it is empty.

    ``tenants`` (a ``tenant_id`` column) lists also those without a row.
    """
    rows = scope(facts, tenant_id)
    described = rows.groupBy(*tenant_keys(tenant_id)).agg(
        F.count("*").alias("total_rows"),
        F.countDistinct("campaign_id").alias("campaigns"),
        F.max("timestamp").alias("latest_timestamp"),
        F.min("timestamp").alias("earliest_timestamp"),
    )
    described = listed(described, tenants, tenant_id)
    status = F.when(F.col("total_rows") > 0, "connected").otherwise("no_data")
    return described.withColumn("status", status)

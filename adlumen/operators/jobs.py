"""Stored daily metrics: refreshing a day, and replacing what a replay rebuilt."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.functions.measures import or_zero
from adlumen.functions.scope import Moment, day_column, moment
from adlumen.operators.eventlog import listed_days, replay_days
from adlumen.operators.live import campaign_day_totals
from adlumen.schemas import TABLES
from adlumen.session import settle
from adlumen.sources import versions
from adlumen.sources.tables import overwrite_days, read_if_any
from adlumen.sources.versions import Version

KEY = ["tenant_id", "campaign_id", "date"]
METRICS = T.StructType([f for f in TABLES["campaign_metrics"].fields if f.name != "id"])


def daily_metrics(campaigns: DataFrame, ads: DataFrame, impressions: DataFrame,
                  tenant_id: int | None = None, day: date | None = None) -> DataFrame:
    """Impressions and spend of a day for every campaign, zeros included."""
    totals = campaign_day_totals(campaigns, ads, impressions, tenant_id, day)
    return totals.select(
        "tenant_id", "campaign_id", day_column(day).alias("date"), "impressions", "spend"
    )


def daily_metrics_upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored metrics with ``fresh`` merged in by tenant, campaign and date.

    A row that exists gets new impressions and spend and keeps the rest; a new
    row starts with zero clicks and conversions; all others stay as they are.
    """
    new = fresh.select(
        *KEY, F.col("impressions").alias("new_impressions"), F.col("spend").alias("new_spend")
    )
    kept = [c for c in stored.columns
            if c not in (*KEY, "impressions", "clicks", "conversions", "spend")]
    return stored.join(new, KEY, "full_outer").select(
        *KEY,
        F.coalesce("new_impressions", "impressions").alias("impressions"),
        or_zero(F.col("clicks")).alias("clicks"),
        or_zero(F.col("conversions")).alias("conversions"),
        F.coalesce("new_spend", "spend").alias("spend"),
        *kept,
    )


def replace_replayed(stored: DataFrame, replayed: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Stored metrics with the rows of replayed campaigns replaced.

    ``campaigns`` (tenant_id, campaign_id) lists what was replayed: a campaign
    whose events give no daily row still loses its old ones.
    """
    kept = stored.join(campaigns, ["tenant_id", "campaign_id"], "left_anti")
    return kept.unionByName(replayed, allowMissingColumns=True)


def rebuild_metrics(stored: DataFrame, log: DataFrame, tenant_id: int | None = None,
                    campaign_id: int | None = None, with_conversions: bool = False) -> DataFrame:
    """Stored metrics with one campaign, one tenant or everything rebuilt from the log.

    A campaign without any event keeps its rows.
    """
    # Both the new rows and the list of campaigns come from one aggregate over all kinds of
    # events, small beside the log and kept, so that the log is read once.
    days = settle(replay_days(log, tenant_id, campaign_id))
    replayed = listed_days(days, with_conversions)
    return replace_replayed(stored, replayed, days.select("tenant_id", "campaign_id").distinct())


def replay_into(spark: SparkSession, table: str, log: DataFrame, tenant_id: int | None = None,
                campaign_id: int | None = None, with_conversions: bool = False) -> Version:
    """Delete and re-create the metrics of what is replayed, in one step.

    ``table`` is a published table (``sources.versions``) of daily metrics.
    Readers see the old rows until the new version stands, never a part of
    both; if another writer published in between, nothing changes and
    ``VersionConflict`` is raised. Only days that lose or get a row are written.
    """
    base = versions.current(spark, table)
    stored = versions.read_version(spark, table, METRICS, base)
    days = settle(replay_days(log, tenant_id, campaign_id))
    replayed = listed_days(days, with_conversions)
    campaigns = settle(days.select("tenant_id", "campaign_id").distinct())
    old = stored.join(campaigns, ["tenant_id", "campaign_id"], "left_semi")
    # One line per calendar day.
    touched = [row[0] for row in old.select("date").union(replayed.select("date")).distinct()
               .collect()]
    if not touched:
        return base
    there = stored.filter(F.col("date").isin([day for day in touched if day]))
    if None in touched:
        there = there.union(stored.filter(F.col("date").isNull()))
    fresh = replace_replayed(there, replayed, campaigns).select(
        *[F.col(f.name).cast(f.dataType) for f in METRICS.fields])
    return versions.publish(spark, table, fresh, base, touched, note="replayed")


def upsert_day(spark: SparkSession, path: str, fresh: DataFrame, day: date) -> None:
    """Merge one day's fresh metrics into the stored table at ``path``.

    Only that day's partition is read and replaced, so a run costs the same
    however long the history is, and repeating it changes nothing.
    """
    stored = read_if_any(spark, path, METRICS).filter(F.col("date") == day_column(day))
    merged = daily_metrics_upsert(stored, fresh)
    overwrite_days(merged.select(*[F.col(f.name).cast(f.dataType) for f in METRICS.fields]), path)


def expire_log(spark: SparkSession, table: str, days: int = 30, as_of: Moment = None) -> int:
    """Delete events older than ``days`` from a managed log table laid out by ``date``.

    Whole expired days are dropped as partitions without reading their rows
    again; only the day the cutoff falls on is rewritten. Returns how many
    events were deleted.
    """
    now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    cutoff = now - timedelta(days=days)
    day = cutoff.date()
    log = spark.table(table)
    upto = log.filter(F.col("date") <= day_column(day))
    deleted = upto.filter(F.col("timestamp") < moment(log, cutoff)).count()
    if not deleted:
        return 0
    # The partition list is table metadata: one line per day.
    stored = [row[0].removeprefix("date=") for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    expired = [text for text in stored if text < day.isoformat()]
    left = upto.filter((F.col("date") == day_column(day))
                       & (F.col("timestamp") >= moment(log, cutoff)))
    if left.isEmpty():
        expired += [text for text in stored if text == day.isoformat()]
    else:
        left.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").insertInto(table)
    if expired:
        names = ", ".join(f"PARTITION (date='{text}')" for text in expired)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {names}")
    return deleted

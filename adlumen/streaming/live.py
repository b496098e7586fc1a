"""Running counters and windowed metrics over the event stream.

Input columns: event_id, event_type, tenant_id, campaign_id, user_id, cost,
timestamp (TIMESTAMP, event time).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.functions.measures import frequency, or_zero
from adlumen.functions.scope import listed
from adlumen.schemas import CLICK, IMPRESSION
from adlumen.streaming.ingest import LATENESS

# How often the live pages are refreshed.
CAMPAIGN_REFRESH, DASHBOARD_REFRESH = "3 seconds", "5 seconds"


def stream_running_counts(events: DataFrame) -> DataFrame:
    """Impressions, clicks, spend and last event time per campaign since the start.

    For output mode update: only campaigns that changed are emitted. Counts are
    merged per task before the shuffle, so a hot campaign is one row per task.
    """
    shown = F.col("event_type") == IMPRESSION
    return events.groupBy("tenant_id", "campaign_id").agg(
        F.count_if(shown).alias("impressions"),
        F.count_if(F.col("event_type") == CLICK).alias("clicks"),
        or_zero(F.sum(F.when(shown, F.col("cost")))).alias("spend"),
        F.max("timestamp").alias("last_update"),
    )


def _windowed(rows: DataFrame, keys: list[str], length: str, step: str | None,
              exact: bool) -> DataFrame:
    """Count, spend and users per key and window.

    Exact users take chained aggregations (per user, then per window) and
    output mode append; approximate ones a sketch per window and mode update.
    Rows are not repeated for windows that overlap: they are first added up
    per user and ``step``, and these panes are what falls into several windows.
    """
    window = F.window("timestamp", length, step)
    if not exact:
        return rows.groupBy(window.alias("window"), *keys).agg(
            F.count("*").alias("impressions"), F.sum("cost").alias("spend"),
            F.approx_count_distinct("user_id").alias("users"),
        )
    panes = rows.groupBy(F.window("timestamp", step or length).alias("pane"), *keys,
                         "user_id").agg(F.count("*").alias("shown"), F.sum("cost").alias("cost"))
    if step:
        per_user = panes.groupBy(F.window(F.window_time("pane"), length, step).alias("window"),
                                 *keys, "user_id").agg(
            F.sum("shown").alias("shown"), F.sum("cost").alias("cost"))
    else:
        per_user = panes.withColumnRenamed("pane", "window")
    return _per_window(per_user, keys)


def _per_window(per_user: DataFrame, keys: list[str]) -> DataFrame:
    # Each sum widens its decimal; the mean needs the digits behind the point.
    spend = F.sum("cost").cast("decimal(20,4)")
    return per_user.groupBy("window", *keys).agg(
        F.sum("shown").alias("impressions"), spend.alias("spend"),
        F.count("user_id").alias("users"),
    )


def stream_live_metrics(events: DataFrame, length: str = "1 hour", step: str = "5 minutes",
                        lateness: str = LATENESS, exact: bool = False) -> DataFrame:
    """Trailing metrics per campaign, one row per window ``step``.

    Rows later than ``lateness`` are left to ``streaming.late``.
    """
    shown = events.filter(F.col("event_type") == IMPRESSION).withWatermark("timestamp", lateness)
    return _metrics(_windowed(shown, ["tenant_id", "campaign_id"], length, step, exact))


def _metrics(totals: DataFrame) -> DataFrame:
    mean = (F.col("spend") / F.col("impressions")).cast("decimal(14,8)")
    return totals.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "tenant_id", "campaign_id", F.col("impressions").alias("impressions_last_hour"),
        F.col("users").alias("unique_users"), F.col("spend").alias("total_spend"),
        mean.alias("avg_cpm"),
        frequency(F.col("impressions"), F.col("users")).alias("frequency"),
    )


def stream_user_panes(events: DataFrame, step: str = "5 minutes",
                      lateness: str = LATENESS) -> DataFrame:
    """What each user was shown per campaign and ``step``, for output mode append.

    One state, and the table it fills answers for every sliding window with
    exact users: see ``windows_of_panes``. Takes a batch as well.
    """
    shown = events.filter(F.col("event_type") == IMPRESSION).withWatermark("timestamp", lateness)
    panes = shown.groupBy(F.window("timestamp", step).alias("pane"), "tenant_id", "campaign_id",
                          "user_id").agg(F.count("*").alias("shown"), F.sum("cost").alias("cost"))
    return panes.select(F.col("pane.start").alias("pane_start"), "tenant_id", "campaign_id",
                        "user_id", "shown", F.col("cost").cast("decimal(20,4)").alias("cost"))


def windows_of_panes(panes: DataFrame, length: str = "1 hour",
                     step: str = "5 minutes") -> DataFrame:
    """The rows of ``stream_live_metrics`` from stored panes, users counted exactly.

    Live pages read the panes of the last ``length`` only. Rows are repeated for
    overlapping windows after they have been added up per user and pane.
    """
    keys = ["tenant_id", "campaign_id"]
    per_user = panes.groupBy(F.window("pane_start", length, step).alias("window"), *keys,
                             "user_id").agg(F.sum("shown").alias("shown"),
                                            F.sum("cost").alias("cost"))
    return _metrics(_per_window(per_user, keys))


def stream_dashboard(events: DataFrame, campaigns: DataFrame, lateness: str = LATENESS,
                     exact: bool = False) -> DataFrame:
    """Impressions, spend and users per tenant and day, under active campaigns."""
    active = campaigns.filter(F.col("status") == "active").select(
        "tenant_id", F.col("id").alias("campaign_id")
    )
    shown = events.filter(F.col("event_type") == IMPRESSION).withWatermark("timestamp", lateness)
    under = shown.join(active, ["tenant_id", "campaign_id"])
    totals = _windowed(under, ["tenant_id"], "1 day", None, exact)
    return totals.select(
        F.to_date("window.start").alias("date"), "tenant_id",
        F.col("impressions").alias("impressions_today"), F.col("spend").alias("spend_today"),
        F.col("users").alias("unique_users_today"),
    )


def with_active_campaigns(day_totals: DataFrame, campaigns: DataFrame,
                          days: list[date] | None = None,
                          tenants: DataFrame | None = None) -> DataFrame:
    """Dashboard rows with the number of active campaigns; tenants without traffic get zeros.

    Takes the state a stream has reached, not one batch of it: a batch holds
    only the tenants that changed. ``days`` lists the days to show; without it
    ``day_totals`` is that of one day. ``tenants`` (a ``tenant_id`` column) are
    by default those with a campaign.
    """
    active = campaigns.groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "active").alias("active_campaigns")
    )
    shown = listed(active, tenants, None)
    if days is not None:
        listed_days = F.array(*[F.lit(day.isoformat()).cast("date") for day in days])
        shown = shown.withColumn("date", F.explode(listed_days))
    keys = ["tenant_id"] if days is None else ["tenant_id", "date"]
    return shown.join(day_totals, keys, "left").fillna(
        0, ["impressions_today", "spend_today", "unique_users_today"]
    )

"""The append-only event log: writing, reading, replaying and checking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.functions.ordered import number_rows
from adlumen.functions.payload import encoded, iso, known_user, money, parsed
from adlumen.functions.scope import Moment, by_date, moment, scope, span, tenant_keys
from adlumen.functions.sizing import lookup_side
from adlumen.schemas import CLICK, CONVERSION, EVENT_TYPES, IMPRESSION
from adlumen.session import settle
from adlumen.sources import versions
from adlumen.sources.versions import VersionConflict

AGGREGATE = ["tenant_id", "aggregate_id"]


def _of_campaign(log: DataFrame, tenant_id: int | None, campaign_id: int | None) -> DataFrame:
    rows = scope(log, tenant_id)
    if campaign_id is None:
        return rows
    return rows.filter(F.col("aggregate_id") == str(campaign_id))


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


# -- writing ---------------------------------------------------------------

# Numbers of an aggregate that are checked together.
STRETCH = 1_000_000


def _event(rows: DataFrame, kind: str, *payload: Column) -> DataFrame:
    return rows.select(
        "id", "tenant_id", F.lit(kind).alias("event_type"),
        F.col("campaign_id").cast("string").alias("aggregate_id"),
        encoded(*payload, _stamp(rows)).alias("payload"), "timestamp",
    )


def _stamp(rows: DataFrame) -> Column:
    plain = isinstance(rows.schema["timestamp"].dataType, T.TimestampNTZType)
    return iso(F.col("timestamp"), plain).alias("timestamp")


def impression_events(rows: DataFrame) -> DataFrame:
    """Log events of impressions (id, tenant_id, campaign_id, ad_id, user_id, cost, timestamp)."""
    return _event(rows, IMPRESSION, F.col("campaign_id"), F.col("ad_id"), F.col("user_id"),
                  F.col("cost").cast("string").alias("cost"))


def click_events(rows: DataFrame) -> DataFrame:
    """Log events of clicks; ``impression_id`` may be NULL."""
    return _event(rows, CLICK, F.col("campaign_id"), F.col("ad_id"), F.col("user_id"),
                  F.col("impression_id"))


def conversion_events(rows: DataFrame) -> DataFrame:
    """Log events of conversions (id, tenant_id, campaign_id, user_id, conversion_value, timestamp)."""
    return _event(rows, CONVERSION, F.col("campaign_id"), F.col("user_id"),
                  F.col("conversion_value").cast("string").alias("conversion_value"))


def recorded_impressions(rows: DataFrame, ads: DataFrame) -> DataFrame:
    """What an impression event also adds to the impression table: rows whose ad
    exists in the same tenant."""
    known = ads.select(F.col("id").alias("ad_id"), "tenant_id")
    return rows.join(known, ["ad_id", "tenant_id"], "left_semi").select(
        "id", "tenant_id", "ad_id", "user_id", "timestamp", "cost"
    )


def last_sequences(log: DataFrame) -> DataFrame:
    """Highest number in use per aggregate."""
    return log.groupBy(*AGGREGATE).agg(F.max("sequence_number").alias("last"))


def advanced_sequences(last: DataFrame, appended: DataFrame) -> DataFrame:
    """``last`` brought forward by a batch just appended."""
    both = last.select(*AGGREGATE, "last").unionByName(last_sequences(appended))
    return both.groupBy(*AGGREGATE).agg(F.max("last").alias("last"))


def append_events(new_events: DataFrame, log: DataFrame | None = None,
                  last: DataFrame | None = None) -> DataFrame:
    """New events with the next sequence numbers of their aggregates.

    Events are numbered by time, then id, which must be unique. The numbers in
    use come from ``log``; where that is long, keep the small table of
    ``last_sequences`` beside it, bring it forward with ``advanced_sequences``
    and pass it as ``last``, and the log need not be read. One writer per log
    at a time: two that read the same maximum would give a number twice. Several
    writers take ``append_reserved``.
    """
    if last is None and log is not None:
        last = last_sequences(log)
    return number_rows(new_events, AGGREGATE, ["timestamp", "id"], "sequence_number", last)


LAST = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("aggregate_id", T.StringType()),
    T.StructField("last", T.LongType()),
])


def reserve_numbers(spark: SparkSession, table: str, new_events: DataFrame, batch: str,
                    tries: int = 20) -> DataFrame:
    """The numbers each aggregate had reached before this batch's own range.

    ``table`` is a published table (``sources.versions``) of last numbers. The
    batch's counts are added to it by compare-and-set: the next version must be
    free, else the newer one is read and the range begins after it. So ranges
    of writers that run at once never overlap and leave no hole between them.
    ``batch`` names the range: a writer that failed after reserving and runs
    again with the same rows gets its range back.
    """
    counts = settle(new_events.groupBy(*AGGREGATE).agg(F.count("*").alias("last")))
    for _ in range(tries):
        mine = versions.noted(spark, table, batch)
        if mine is not None:
            base = mine.number - 1
            before = versions.version(spark, table, base) if base else versions.NONE
            return versions.read_version(spark, table, LAST, before)
        base = versions.current(spark, table)
        reached = versions.read_version(spark, table, LAST, base)
        forward = reached.unionByName(counts).groupBy(*AGGREGATE).agg(F.sum("last").alias("last"))
        rows = forward.select(*[F.col(f.name).cast(f.dataType) for f in LAST.fields])
        try:
            versions.publish(spark, table, rows, base, note=batch)
        except VersionConflict:
            continue
        return reached
    raise VersionConflict(f"{table}: no range for {batch} after {tries} tries")


def append_reserved(spark: SparkSession, new_events: DataFrame, table: str, batch: str) -> DataFrame:
    """``append_events`` for any number of writers, each with a ``batch`` name of its own.

    Within a batch events are numbered by time, then id; batches follow each
    other in the order in which they reserved their ranges.
    """
    return append_events(new_events, last=reserve_numbers(spark, table, new_events, batch))


def facts_as_events(impressions: DataFrame, clicks: DataFrame,
                    conversions: DataFrame) -> DataFrame:
    """Log rows, not yet numbered, for stored facts.

    The aggregate is the campaign, found by following conversion to click to
    impression; facts whose chain is broken give no event.
    """
    origin = impressions.select(F.col("id").alias("impression_id"), "campaign_id")
    clicked = clicks.join(origin, "impression_id")
    click_origin = clicked.select(F.col("id").alias("click_id"), "campaign_id")
    converted = conversions.join(click_origin, "click_id")

    def event(rows: DataFrame, kind: str, *payload: Column) -> DataFrame:
        return rows.select(
            "tenant_id", F.lit(kind).alias("event_type"),
            F.col("campaign_id").cast("string").alias("aggregate_id"),
            encoded(*payload).alias("payload"), "timestamp", F.col("id").alias("source_id"),
        )

    shown = event(impressions, IMPRESSION, F.col("id").alias("impression_id"), F.col("ad_id"),
                  F.col("user_id"), F.col("cost").cast("string").alias("cost"))
    clicked = event(clicked, CLICK, F.col("id").alias("click_id"), F.col("impression_id"))
    converted = event(converted, CONVERSION, F.col("id").alias("conversion_id"),
                      F.col("click_id"),
                      F.col("conversion_value").cast("string").alias("value"))
    return shown.unionByName(clicked).unionByName(converted)


def log_from_facts(impressions: DataFrame, clicks: DataFrame, conversions: DataFrame,
                   log: DataFrame | None = None) -> DataFrame:
    """Stored facts as numbered log rows, continuing ``log`` where one is given."""
    last = None if log is None else last_sequences(log)
    return number_rows(
        facts_as_events(impressions, clicks, conversions), AGGREGATE,
        ["timestamp", "event_type", "source_id"], "sequence_number", last,
    )


# -- reading ---------------------------------------------------------------

# Spark's own top-n per key holds this many rows of a key in a task.
FEW = 1000


def event_stream(log: DataFrame, tenant_id: int | None = None, campaign_id: int | None = None,
                 limit: int = 100, few: int = FEW) -> DataFrame:
    """Newest events of a campaign, payload included; of each when none is named.

    Up to ``few`` Spark keeps only ``limit`` rows per campaign and task before
    shuffling. Beyond that events are counted by hour, hours older than the
    limit are not read again, and the rest is numbered in even pieces: no task
    holds a campaign's log, however large it and the limit are.
    """
    rows = _of_campaign(log, tenant_id, campaign_id)
    if limit > few:
        return _newest_many(rows, limit, tenant_id is not None and campaign_id is not None)
    columns = [F.col("id").alias("event_id"), "event_type", "timestamp", "payload",
               "sequence_number"]
    newest = [F.desc("timestamp"), F.desc("id")]
    if campaign_id is not None and tenant_id is not None:
        return rows.orderBy(*newest).limit(limit).select(*columns)
    place = F.row_number().over(Window.partitionBy(*AGGREGATE).orderBy(*newest))
    listed = rows.withColumn("_place", place).filter(F.col("_place") <= limit)
    return listed.select(*AGGREGATE, *columns)


def _newest_many(rows: DataFrame, limit: int, alone: bool) -> DataFrame:
    hours = rows.groupBy(*AGGREGATE, F.date_trunc("hour", "timestamp").alias("_hour")).agg(
        F.count("*").alias("_rows"))
    newer = Window.partitionBy(*AGGREGATE).orderBy(F.desc("_hour")).rowsBetween(
        Window.unboundedPreceding, -1)
    # Hours of a campaign that still count: those with fewer than limit events after them.
    needed = hours.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0))).filter(
        F.col("_newer") < limit)
    since = settle(needed.groupBy(*AGGREGATE).agg(F.min("_hour").alias("_since")))
    oldest = since.agg(F.min("_since")).first()[0]
    if oldest is not None:
        rows = by_date(rows.filter(F.col("timestamp") >= F.lit(oldest)), F.lit(oldest))
    recent = rows.join(lookup_side(since), AGGREGATE).filter(F.col("timestamp") >= F.col("_since"))
    back = recent.drop("_since").withColumn(
        "_age", -F.unix_micros(F.col("timestamp").cast("timestamp"))).withColumn("_back", -F.col("id"))
    placed = number_rows(back, AGGREGATE, ["_age", "_back"], "_place").filter(F.col("_place") <= limit)
    columns = [F.col("id").alias("event_id"), "event_type", "timestamp", "payload",
               "sequence_number"]
    if alone:
        return placed.orderBy("_place").select(*columns)
    return placed.select(*AGGREGATE, *columns)


def audit_trail(log: DataFrame, tenant_id: int | None = None,
                campaign_id: int | None = None) -> DataFrame:
    """The newest hundred events."""
    return event_stream(log, tenant_id, campaign_id, limit=100)


def event_stats(log: DataFrame, tenant_id: int | None = None, as_of: Moment = None) -> DataFrame:
    """Events in total, in the last hour and per known type, in one pass."""
    now = moment(log, as_of)
    recent = (F.col("timestamp") >= now - span(hours=1)) & (F.col("timestamp") <= now)
    return scope(log, tenant_id).groupBy(*tenant_keys(tenant_id)).agg(
        F.count("*").alias("total_events"),
        F.count_if(recent).alias("events_last_hour"),
        *[F.count_if(_is(kind)).alias(kind) for kind in EVENT_TYPES],
    )


def event_batch_counts(log: DataFrame, event_ids: DataFrame,
                       tenant_id: int | None = None) -> DataFrame:
    """Events of a list (column ``event_id``) by type.

    ``events_processed`` is the length of the list, ``matched`` how many of its
    events exist in the tenant.
    """
    listed = event_ids.select(F.col("event_id").alias("id"))
    found = scope(log, tenant_id).select("id", "event_type").join(listed, "id", "left_semi")
    parts = listed.select(F.lit(1).alias("listed")).unionByName(
        found.select("event_type", F.lit(1).alias("found")), allowMissingColumns=True
    )
    return parts.agg(
        F.count("listed").alias("events_processed"),
        F.count("found").alias("matched"),
        F.count_if(_is(IMPRESSION)).alias("impressions"),
        F.count_if(_is(CLICK)).alias("clicks"),
        F.count_if(_is(CONVERSION)).alias("conversions"),
    )


# -- retention -------------------------------------------------------------

def _expired(log: DataFrame, days: int, tenant_id: int | None, as_of: Moment) -> Column:
    old = F.col("timestamp") < moment(log, as_of) - span(days=days)
    return old if tenant_id is None else old & (F.col("tenant_id") == tenant_id)


def retained_events(log: DataFrame, days: int = 30, tenant_id: int | None = None,
                    as_of: Moment = None) -> DataFrame:
    """The log without events older than ``days``; other tenants' stay if one is named."""
    kept = log.filter(~_expired(log, days, tenant_id, as_of))
    # With a tenant named, the old days of the others are still read.
    return kept if tenant_id is not None else by_date(kept, moment(log, as_of) - span(days=days))


def retention_split(log: DataFrame, days: int = 30, tenant_id: int | None = None,
                    as_of: Moment = None) -> DataFrame:
    """Per tenant, how many events a cleanup keeps and deletes."""
    expired = _expired(log, days, tenant_id, as_of)
    return log.groupBy("tenant_id").agg(
        F.count_if(~expired).alias("kept_events"), F.count_if(expired).alias("deleted_events")
    )


# -- replay ----------------------------------------------------------------

def _replayable(log: DataFrame, tenant_id: int | None, campaign_id: int | None) -> DataFrame:
    rows = _of_campaign(log, tenant_id, campaign_id)
    body = rows.select(
        "tenant_id", F.col("aggregate_id").try_cast("bigint").alias("campaign_id"),
        F.to_date("timestamp").alias("date"), "event_type", parsed().alias("body"),
    )
    return body.select(
        "tenant_id", "campaign_id", "date", "event_type",
        known_user(F.col("body.user_id")).alias("user"), money(F.col("body.cost")).alias("cost"),
    )


def event_replay(log: DataFrame, tenant_id: int | None = None, campaign_id: int | None = None,
                 with_conversions: bool = False) -> DataFrame:
    """Daily metrics of all campaigns rebuilt from the log.

    Sums and distinct counts do not depend on order, so nothing is sorted.
    Conversions are 0 in daily rows and days with conversions only are not
    listed, unless ``with_conversions`` is set.
    """
    return listed_days(replay_days(log, tenant_id, campaign_id), with_conversions)


def replay_days(log: DataFrame, tenant_id: int | None = None,
                campaign_id: int | None = None) -> DataFrame:
    """Figures of every campaign day with any event, of any type."""
    rows = _replayable(log, tenant_id, campaign_id)
    seen = F.col("event_type").isin(IMPRESSION, CLICK)
    return rows.groupBy("tenant_id", "campaign_id", "date").agg(
        F.count_if(_is(IMPRESSION)).alias("impressions"),
        F.count_if(_is(CLICK)).alias("clicks"),
        F.count_if(_is(CONVERSION)).alias("conversions"),
        F.coalesce(F.sum(F.when(_is(IMPRESSION), F.col("cost"))), F.lit(0)).alias("spend"),
        F.countDistinct(F.when(seen, F.col("user"))).alias("unique_users"),
    )


def listed_days(days: DataFrame, with_conversions: bool) -> DataFrame:
    """The days of ``replay_days`` that daily metrics list."""
    counted = F.col("impressions") + F.col("clicks")
    if with_conversions:
        return days.filter(counted + F.col("conversions") > 0)
    return days.filter(counted > 0).withColumn("conversions", F.lit(0).cast("bigint"))


def event_totals(log: DataFrame, tenant_id: int | None = None,
                 campaign_id: int | None = None) -> DataFrame:
    """Campaign totals from the log; ``replayed_events`` counts unknown types too."""
    rows = _replayable(log, tenant_id, campaign_id)
    known = F.col("event_type").isin(*EVENT_TYPES)
    return rows.groupBy("tenant_id", "campaign_id").agg(
        F.count("*").alias("replayed_events"),
        F.count_if(_is(IMPRESSION)).alias("total_impressions"),
        F.count_if(_is(CLICK)).alias("total_clicks"),
        F.count_if(_is(CONVERSION)).alias("total_conversions"),
        F.coalesce(F.sum(F.when(_is(IMPRESSION), F.col("cost"))), F.lit(0)).alias("total_spend"),
        F.countDistinct(F.when(known, F.col("user"))).alias("unique_users"),
    )


def logged_campaigns(log: DataFrame, tenant_id: int | None = None,
                     campaign_id: int | None = None) -> DataFrame:
    """Campaigns with at least one event of any type."""
    rows = _of_campaign(log, tenant_id, campaign_id)
    return rows.select(
        "tenant_id", F.col("aggregate_id").try_cast("bigint").alias("campaign_id")
    ).distinct()


# -- checking --------------------------------------------------------------

def _with_expected(log: DataFrame, tenant_id: int | None, campaign_id: int | None) -> DataFrame:
    """Each event with the number that should follow the one before it.

    Numbers are cut into stretches of fixed length, which bound what meets in
    one task; what precedes a stretch is the last number of the one before. The
    stretches are few and broadcast while they are, so events are shuffled once.
    """
    rows = _of_campaign(log, tenant_id, campaign_id).select(
        *AGGREGATE, "sequence_number", "id",
        F.coalesce(F.floor(F.col("sequence_number") / STRETCH), F.lit(-1)).alias("_stretch"))
    ends = rows.groupBy(*AGGREGATE, "_stretch").agg(F.max("sequence_number").alias("_end"))
    along = Window.partitionBy(*AGGREGATE).orderBy("_stretch")
    carried = ends.select(*AGGREGATE, "_stretch", F.lag("_end").over(along).alias("_carried"))
    within = Window.partitionBy(*AGGREGATE, "_stretch").orderBy("sequence_number", "id")
    looked = rows.withColumn("_near", F.lag("sequence_number").over(within)).join(
        lookup_side(carried), [*AGGREGATE, "_stretch"])
    before = F.coalesce("_near", "_carried", F.lit(0))
    return looked.withColumn("expected", before + 1)


def sequence_gaps(log: DataFrame, tenant_id: int | None = None,
                  campaign_id: int | None = None) -> DataFrame:
    """Events whose number is not one more than the number before; the first must be 1.

    A repeated number counts as a gap too.
    """
    rows = _with_expected(log, tenant_id, campaign_id)
    return rows.filter(F.col("sequence_number") != F.col("expected")).select(
        *AGGREGATE, "expected", F.col("sequence_number").alias("found"),
        F.col("id").alias("event_id"),
    )


def validate_sequence(log: DataFrame, tenant_id: int | None = None,
                      campaign_id: int | None = None) -> DataFrame:
    """Per aggregate: whether its numbers are whole, how many events, the last number.

    One campaign of one tenant gives one row even if it has no events.
    """
    rows = _with_expected(log, tenant_id, campaign_id)
    alone = tenant_id is not None and campaign_id is not None
    return rows.groupBy(*([] if alone else AGGREGATE)).agg(
        (F.count_if(F.col("sequence_number") != F.col("expected")) == 0).alias("valid"),
        F.count_if(F.col("sequence_number") != F.col("expected")).alias("gaps"),
        F.count("*").alias("total_events"),
        F.coalesce(F.max("sequence_number"), F.lit(0)).alias("last_sequence"),
    )

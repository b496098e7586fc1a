"""The test tables seen as campaign tables.

All are thin projections; what Spark prunes from a query is never read.

* ad: every part; its campaign is one of twenty, its tenant one of three.
* campaign: the twenty groups of parts.
* impression, by volume: every line item, shown to the order as user.
* impression, by event: every ``view`` event. A ``click`` belongs to the last
  earlier view of its user and tenant, a ``purchase`` to their last earlier
  click; those without one lead nowhere.
* log: every event; ``error`` events get a sequence number but are missing
  from the log, which leaves gaps.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlumen.functions.ordered import number_rows
from adlumen.operators.eventlog import AGGREGATE
from adlumen.operators.warehouse import as_warehouse_rows

CAMPAIGNS, TENANTS = 20, 3
PAUSED_EVERY = 5

# Points in time at which the registered queries look at the data.
EVENT_NOON = datetime(2024, 1, 30, 12)
EVENT_DAY = date(2024, 1, 20)
VOLUME_NOW = datetime(2002, 1, 1)
VOLUME_DAY = date(2000, 4, 4)


# Schemas of the tables in use; with them no file is opened just to plan a query.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _campaign_of(ad: Column) -> Column:
    return F.pmod(ad, F.lit(CAMPAIGNS))


def _tenant_of(campaign: Column) -> Column:
    return (F.pmod(campaign, F.lit(TENANTS)) + 1).cast("int")


def ads(spark: SparkSession, folder: str) -> DataFrame:
    campaign = _campaign_of(F.col("p_partkey"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), _tenant_of(campaign).alias("tenant_id"),
        campaign.alias("campaign_id"), F.col("p_name").alias("creative_url"),
        F.col("p_type").alias("target_audience"),
    )


def campaigns(spark: SparkSession, folder: str) -> DataFrame:
    number = _campaign_of(F.col("p_partkey")).alias("id")
    grouped = table(spark, folder, "part").groupBy(number).agg(
        F.sum(F.col("p_retailprice").cast("decimal(12,2)")).alias("budget")
    )
    paused = F.pmod("id", F.lit(PAUSED_EVERY)) == PAUSED_EVERY - 1
    return grouped.select(
        "id", _tenant_of(F.col("id")).alias("tenant_id"),
        F.concat(F.lit("Campaign "), F.col("id").cast("string")).alias("name"), "budget",
        F.when(paused, "paused").otherwise("active").alias("status"),
        F.lit("1995-01-01").cast("date").alias("start_date"),
        F.lit("2024-12-31").cast("date").alias("end_date"),
    )


def tenants(spark: SparkSession, folder: str) -> DataFrame:
    """One tenant per region; those beyond TENANTS have neither campaigns nor traffic."""
    return table(spark, folder, "region").select(
        (F.col("r_regionkey") + 1).cast("int").alias("tenant_id"))


def volume_impressions(spark: SparkSession, folder: str) -> DataFrame:
    campaign = _campaign_of(F.col("l_partkey"))
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("ad_id"), _tenant_of(campaign).alias("tenant_id"),
        F.col("l_orderkey").alias("user_id"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_extendedprice") / 100).cast("decimal(10,4)").alias("cost"),
    )


def _as_events(table_rows: DataFrame) -> DataFrame:
    ad = F.from_json("props", "k BIGINT").getField("k")
    rows = table_rows.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id", "event_type",
        "value", ad.alias("ad_id"),
    )
    campaign = _campaign_of(F.col("ad_id"))
    return rows.withColumn("campaign_id", campaign).withColumn("tenant_id", _tenant_of(campaign))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _as_events(table(spark, folder, "events"))


def live_events(rows: DataFrame) -> DataFrame:
    """Rows of the events table, static or streaming, as views and clicks on the live topics."""
    kind = F.col("event_type")
    name = F.when(kind == "view", "impression_created").when(kind == "click", "click_registered")
    return _as_events(rows).select(
        F.col("id").alias("event_id"), name.alias("event_type"), "tenant_id", "campaign_id",
        "ad_id", "user_id",
        F.when(kind == "view", F.col("value").cast("decimal(10,4)")).alias("cost"),
        F.col("timestamp").cast("timestamp").alias("timestamp"),
    ).filter(F.col("event_type").isNotNull())


def impressions(spark: SparkSession, folder: str) -> DataFrame:
    views = _events(spark, folder).filter(F.col("event_type") == "view")
    return views.select("id", "tenant_id", "ad_id", "user_id", "timestamp",
                        F.col("value").cast("decimal(10,4)").alias("cost"))


def impression_facts(spark: SparkSession, folder: str) -> DataFrame:
    views = _events(spark, folder).filter(F.col("event_type") == "view")
    return views.select("id", "tenant_id", "campaign_id", "ad_id", "user_id", "timestamp",
                        F.col("value").cast("decimal(10,4)").alias("cost"))


def reported(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Views, clicks or purchases (kind impression, click, conversion) as they were reported."""
    name = {"impression": "view", "click": "click", "conversion": "purchase"}[kind]
    value = "conversion_value" if kind == "conversion" else "cost"
    rows = _events(spark, folder).filter(F.col("event_type") == name)
    return rows.select("id", "tenant_id", "campaign_id", "ad_id", "user_id", "timestamp",
                       F.col("value").cast("decimal(10,4)").alias(value))


def _following(spark: SparkSession, folder: str, kind: str, origin: str, name: str) -> DataFrame:
    """Events of one kind with the last earlier ``origin`` event of their user and tenant."""
    earlier = Window.partitionBy("tenant_id", "user_id").orderBy("timestamp", "id").rowsBetween(
        Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == origin, F.col("id")), ignorenulls=True)
    rows = _events(spark, folder).filter(F.col("event_type").isin(kind, origin))
    return rows.withColumn(name, last.over(earlier)).filter(F.col("event_type") == kind)


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return _following(spark, folder, "click", "view", "impression_id").select(
        "id", "tenant_id", "impression_id", "timestamp")


def conversions(spark: SparkSession, folder: str) -> DataFrame:
    return _following(spark, folder, "purchase", "click", "click_id").select(
        "id", "tenant_id", "click_id", "timestamp",
        F.col("value").cast("decimal(10,2)").alias("conversion_value"))


def _log_rows(spark: SparkSession, folder: str, *leaving_out: str) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "impression_created").when(kind == "click", "click_registered")
        .when(kind == "purchase", "conversion_tracked").otherwise(kind)
    )
    cost = F.col("value").cast("decimal(10,4)").cast("string").alias("cost")
    rows = _events(spark, folder).filter(~kind.isin(*leaving_out))
    return rows.select(
        "id", "tenant_id", F.col("campaign_id").cast("string").alias("aggregate_id"),
        name.alias("event_type"), F.to_json(F.struct("user_id", cost)).alias("payload"),
        "timestamp",
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The log without numbers, for operators that do not look at them."""
    return _log_rows(spark, folder, "error")


def numbered_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with the numbers its events got when ``error`` events still counted."""
    rows = number_rows(_log_rows(spark, folder), AGGREGATE, ["timestamp", "id"],
                       "sequence_number")
    return rows.filter(F.col("event_type") != "error")


def warehouse(spark: SparkSession, folder: str) -> DataFrame:
    return as_warehouse_rows(impressions(spark, folder), ads(spark, folder)).drop("id")


def stored_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics already stored: what line items returned say, up to the merge day."""
    campaign = _campaign_of(F.col("l_partkey"))
    rows = table(spark, folder, "lineitem").select(
        _tenant_of(campaign).alias("tenant_id"), campaign.alias("campaign_id"),
        F.to_date("l_shipdate").alias("date"), "l_returnflag",
    )
    return rows.groupBy("tenant_id", "campaign_id", "date").agg(
        F.lit(1).cast("bigint").alias("impressions"),
        F.count_if(F.col("l_returnflag") == "R").alias("clicks"),
        F.count_if(F.col("l_returnflag") == "A").alias("conversions"),
        F.lit("1.00").cast("decimal(12,2)").alias("spend"),
    )


def kept_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics already stored for event days: errors as clicks, also of campaigns the log lacks."""
    rows = _events(spark, folder).select(
        "tenant_id", F.explode(F.array("campaign_id", F.col("campaign_id") + CAMPAIGNS))
        .alias("campaign_id"), F.to_date("timestamp").alias("date"), "event_type")
    return rows.groupBy("tenant_id", "campaign_id", "date").agg(
        F.count("*").alias("impressions"),
        F.count_if(F.col("event_type") == "error").alias("clicks"),
        F.lit(0).cast("bigint").alias("conversions"),
        F.lit("1.00").cast("decimal(12,2)").alias("spend"),
        F.lit(None).cast("bigint").alias("unique_users"),
    )


def grants(spark: SparkSession, folder: str) -> DataFrame:
    """Permissions: what suppliers delivered, as resource and action."""
    return table(spark, folder, "lineitem").select(
        F.lit(1).alias("tenant_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_returnflag").alias("resource"), F.col("l_linestatus").alias("action"),
    )


def permission_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests in the same terms, with parts as users."""
    return table(spark, folder, "lineitem").select(
        F.lit(1).alias("tenant_id"), F.col("l_partkey").alias("user_id"),
        F.col("l_returnflag").alias("resource"), F.col("l_linestatus").alias("action"),
        "l_orderkey", "l_linenumber",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users of their nation, with a role by market segment."""
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant_id"),
        F.when(segment == "MACHINERY", "admin").when(segment == "HOUSEHOLD", "super_admin")
        .otherwise("user").alias("role"),
    )

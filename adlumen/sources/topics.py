"""Live topics: one per tenant and kind of event, JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlumen.schemas import CLICK, IMPRESSION, MESSAGE

# Topic names.
TOPIC_PREFIX = {IMPRESSION: "impressions-tenant-", CLICK: "clicks-tenant-"}


def topic_of(kind: str, tenant_id: int) -> str:
    return f"{TOPIC_PREFIX[kind]}{tenant_id}"


def topic_column() -> Column:
    """Topic of a message by event type and tenant; NULL for kinds without one."""
    kind = F.col("event_type")
    prefix = F.when(kind == IMPRESSION, TOPIC_PREFIX[IMPRESSION]).when(
        kind == CLICK, TOPIC_PREFIX[CLICK]
    )
    return F.concat(prefix, F.col("tenant_id").cast("string"))


def kafka_messages(spark: SparkSession, servers: str, tenant_id: int | None = None) -> DataFrame:
    """Raw messages from Kafka: the tenant's two topics, or those of all tenants.

    Needs the Kafka connector on the class path.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    if tenant_id is None:
        reader = reader.option("subscribePattern", "(impressions|clicks)-tenant-.*")
    else:
        topics = [topic_of(kind, tenant_id) for kind in TOPIC_PREFIX]
        reader = reader.option("subscribe", ",".join(topics))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_messages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw messages from text files dropped into a folder, one JSON object per line."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def decoded(messages: DataFrame) -> DataFrame:
    """Messages as columns; what is not JSON or has no tenant is dropped.

    User and cost may sit at the top or in the nested ``data`` object.
    """
    body = messages.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")
    columns = body.select(
        "event_id", "event_type", "tenant_id", "campaign_id", "ad_id",
        F.coalesce("user_id", F.col("data.user_id")).alias("user_id"),
        "impression_id",
        F.coalesce("cost", F.col("data.cost")).try_cast("decimal(10,4)").alias("cost"),
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
    )
    return columns.filter(F.col("tenant_id").isNotNull() & F.col("event_type").isNotNull())


def encoded_messages(events: DataFrame) -> DataFrame:
    """Events as (topic, value) rows, ready for a topic sink."""
    fields = [F.col(name) for name in events.columns if name not in ("cost", "timestamp")]
    if "cost" in events.columns:
        fields.append(F.col("cost").cast("string").alias("cost"))
    fields.append(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
    return events.select(
        topic_column().alias("topic"), F.to_json(F.struct(*fields)).alias("value")
    ).filter(F.col("topic").isNotNull())

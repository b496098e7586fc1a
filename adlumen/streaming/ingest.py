"""Getting events into and out of topics, each counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from adlumen.functions.scope import scope
from adlumen.schemas import CLICK, IMPRESSION
from adlumen.sources.topics import decoded, encoded_messages

# How late an event may be; windows of what comes later still are repaired (``streaming.late``).
LATENESS = "10 minutes"


def stream_ingest_events(messages: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Impressions and clicks from raw topic messages."""
    events = scope(decoded(messages), tenant_id)
    return events.filter(F.col("event_type").isin(IMPRESSION, CLICK))


def stream_dedup_events(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Redelivered messages dropped, as long as they come within the lateness.

    State holds one key per event of that span and no more.
    """
    timed = events.withWatermark("timestamp", lateness)
    return timed.dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def stream_publish(events: DataFrame) -> DataFrame:
    """Events as (topic, value) rows: the columns a Kafka sink expects."""
    return encoded_messages(events)


def publish_to_files(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writer with one folder per topic, one JSON object per line."""
    return (
        stream_publish(events).writeStream.format("text").partitionBy("topic")
        .option("path", folder).option("checkpointLocation", checkpoint)
    )


def publish_to_kafka(events: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """Writer to Kafka. Needs the Kafka connector on the class path."""
    return (
        stream_publish(events).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint)
    )

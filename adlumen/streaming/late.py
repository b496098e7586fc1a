"""Rows that come after their window was closed: set aside on arrival, windows repaired.

A windowed stream forgets what is older than its watermark. So arriving rows
are landed first, in one table, each marked with whether it is late: older than
the newest row of the batches before it by more than the lateness. The live
report streams over the rows in time and loses none of them; the late ones tell
which closed windows are wrong, and those alone are computed again from all
landed rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from adlumen.sources.tables import read_if_any
from adlumen.streaming.ingest import LATENESS

_SEEN = "newest TIMESTAMP, batch BIGINT"


def land_events(events: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS,
                column: str = "timestamp") -> DataStreamWriter:
    """Writer of all rows below ``path``, late ones and those in time apart.

    What counts as late is decided by the batches before, whose newest times are
    kept beside the rows, so a batch that is run again decides the same and
    overwrites its own folders.
    """
    def land(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        seen = read_if_any(spark, f"{path}/seen", T._parse_datatype_string(_SEEN))
        newest = seen.filter(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        kept = rows.persist()
        try:
            late = F.lit(False)
            if newest is not None:
                late = F.coalesce(
                    F.col(column) < F.lit(newest) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
            kept.select("*", late.alias("late"), F.lit(batch).cast("bigint").alias("batch")).hint(
                "rebalance").write.option("partitionOverwriteMode", "dynamic").partitionBy(
                "late", "batch").mode("overwrite").parquet(f"{path}/rows")
            kept.agg(F.max(column).alias("newest")).withColumn(
                "batch", F.lit(batch).cast("bigint")).write.option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").mode(
                "overwrite").parquet(f"{path}/seen")
        finally:
            kept.unpersist()

    return events.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint).foreachBatch(land)


def rows_in_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The landed rows that were in time, as a stream."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.readStream.schema(full).parquet(f"{path}/rows/late=false")
    return rows.select(*schema.names)


def landed(spark: SparkSession, path: str, schema: T.StructType,
           late: bool | None = None) -> DataFrame:
    """All landed rows, or the late ones, or those in time."""
    full = T.StructType([*schema.fields, T.StructField("late", T.BooleanType()),
                         T.StructField("batch", T.LongType())])
    rows = read_if_any(spark, f"{path}/rows", full)
    if late is not None:
        rows = rows.filter(F.col("late") == late)
    return rows.select(*schema.names)


def repaired_windows(report_rows: DataFrame, history: DataFrame, late: DataFrame,
                     report: Callable[[DataFrame], DataFrame], keys: list[str],
                     start: str, length: timedelta, step: timedelta | None = None,
                     of: str = "timestamp") -> DataFrame:
    """``report_rows`` with the windows that late rows belong to computed again.

    ``report`` is the report itself, over ``history`` (all rows, late ones too);
    ``keys`` identify its rows together with ``start``, the start of the window
    (a time, or the date of a day). Only history within reach of a late row is
    read, so the repair costs what the lateness spans and not the whole past.
    """
    def text(span: timedelta) -> str:
        return f"{int(span.total_seconds())} seconds"

    window = F.window(of, text(length), text(step or length))
    kind = report_rows.schema[start].dataType
    wrong = late.select(window.alias("_window"), *keys).select(
        F.col("_window.start").cast(kind).alias(start), *keys,
        F.col("_window.start").alias("_from"), F.col("_window.end").alias("_to")).distinct()
    first, last = wrong.agg(F.min("_from"), F.max("_to")).first()
    if first is None:
        return report_rows
    there = history.filter((F.col(of) >= F.lit(first)) & (F.col(of) < F.lit(last))).join(
        wrong.select(*keys).distinct(), keys, "left_semi")
    wrong = wrong.select(start, *keys)
    again = report(there).join(wrong, [start, *keys], "left_semi")
    right = report_rows.join(wrong, [start, *keys], "left_anti")
    return right.unionByName(again).select(*report_rows.columns)

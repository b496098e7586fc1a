"""Writing stream results so that a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from adlumen.operators.warehouse import COPY, COPY_ORDER, as_warehouse_rows
from adlumen.session import settle
from adlumen.sources import versions
from adlumen.streaming.live import stream_running_counts


def _by_batch(path: str, prepare: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` body that keeps each batch in a folder of its own.

    A batch that is run again after a failure overwrites its own folder.
    """
    def write(rows: DataFrame, batch: int) -> None:
        labelled = prepare(rows).withColumn("batch", F.lit(batch).cast("bigint"))
        labelled.hint("rebalance").write.option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch"
        ).mode("overwrite").parquet(path)

    return write


def changes_to_files(rows: DataFrame, path: str, checkpoint: str,
                     prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                     every: str | None = None) -> DataStreamWriter:
    """Writer of an update-mode stream: the changed rows of every batch.

    ``every`` sets the refresh interval of a live page.
    """
    writer = rows.writeStream.outputMode("update").option(
        "checkpointLocation", checkpoint
    ).foreachBatch(_by_batch(path, prepare))
    return writer.trigger(processingTime=every) if every else writer


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, *keys: str) -> DataFrame:
    """The state an update-mode stream has reached: each key's row of its latest batch."""
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    stored = spark.read.schema(full).parquet(path)
    newest = stored.groupBy(*keys).agg(
        F.max_by(F.struct(*schema.names), "batch").alias("newest"))
    return newest.select("newest.*")


def compact(spark: SparkSession, path: str, schema: T.StructType, *keys: str,
            below: int) -> None:
    """Fold all batches below a finished one into it, so that the history stays short.

    The newest rows as of batch ``below - 1`` become that batch's folder; a
    repeated run gives the same. Run it while no reader is at the old folders.
    """
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    old = spark.read.schema(full).parquet(path).filter(F.col("batch") < below)
    folders = [row[0] for row in old.select("batch").distinct().collect()]
    if len(folders) < 2:
        return
    newest = settle(old.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("n")))
    newest.select("n.*").withColumn("batch", F.lit(max(folders)).cast("bigint")).write.option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").mode("overwrite").parquet(path)
    for batch in sorted(folders)[:-1]:
        _delete(spark, f"{path}/batch={batch}")


def state_to_versions(rows: DataFrame, table: str, checkpoint: str, *keys: str,
                      fold_every: int = 20, keep: int = 5, every: str | None = None
                      ) -> DataStreamWriter:
    """Writer of an update-mode stream into a published table that stays short by itself.

    A batch adds its changed rows; every ``fold_every`` folders the newest row
    of each key is written as one, and versions older than ``keep`` go with what
    only they list. Readers (``latest_state``) hold on to the version they
    began with, and a batch that is run again changes nothing.
    """
    schema = _with_batch(rows.schema)

    def add(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        base = versions.current(spark, table)
        if base.note and int(base.note) >= batch:
            return
        labelled = changed.withColumn("batch", F.lit(batch).cast("bigint"))
        fold = len(base.parts) + 1 >= fold_every
        if fold:
            earlier = versions.read_version(spark, table, schema, base)
            labelled = _newest(earlier.unionByName(labelled), schema, keys)
        versions.publish(spark, table, labelled, base, None if fold else (), str(batch))
        versions.expire(spark, table, keep)

    writer = rows.writeStream.outputMode("update").option(
        "checkpointLocation", checkpoint).foreachBatch(add)
    return writer.trigger(processingTime=every) if every else writer


def latest_state(spark: SparkSession, table: str, schema: T.StructType, *keys: str) -> DataFrame:
    """Each key's newest row in the newest version of a ``state_to_versions`` table."""
    full = _with_batch(schema)
    return _newest(versions.read_version(spark, table, full), full, keys).select(*schema.names)


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _newest(rows: DataFrame, schema: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.names), "batch").alias("newest"))
    return newest.select("newest.*")


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def rows_to_files(rows: DataFrame, path: str, checkpoint: str, *partition: str
                  ) -> DataStreamWriter:
    """Writer of an append-mode stream, exactly once, laid out by ``partition``."""
    writer = rows.writeStream.outputMode("append").format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partition) if partition else writer


def stream_metric_snapshot(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends the running counts of changed campaigns with the batch time."""
    def snapshot(rows: DataFrame) -> DataFrame:
        return rows.select(
            "tenant_id", "campaign_id", "impressions", "clicks",
            F.col("spend").cast("decimal(12,2)").alias("spend"),
            F.current_timestamp().alias("timestamp"),
        )

    return changes_to_files(stream_running_counts(events), path, checkpoint, snapshot)


def stream_sync(impressions: DataFrame, ads: DataFrame, path: str, checkpoint: str
                ) -> DataStreamWriter:
    """Writer that keeps the warehouse copy up to date; the checkpoint is its mark."""
    rows = as_warehouse_rows(impressions, ads).drop("id")
    return rows_to_files(rows.withColumn("date", F.to_date("timestamp")), path, checkpoint, "date")


def stream_sync_published(impressions: DataFrame, ads: Callable[[], DataFrame], table: str,
                          checkpoint: str) -> DataStreamWriter:
    """The same into a published table (``sources.versions``), with a lookup that may change.

    ``ads`` is called for every batch: an ad added after the start is found, and
    whether the lookup is sent along is decided by its size at that time. A
    batch is published in one step under its number, so one that is run again
    changes nothing; closed days are joined by ``warehouse.compact_copy``.
    """
    def publish(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        while True:
            base = versions.current(spark, table)
            if base.note and int(base.note) >= batch:
                return
            dated = as_warehouse_rows(rows, ads()).withColumn("date", F.to_date("timestamp"))
            ready = dated.select(*[F.col(f.name).cast(f.dataType) for f in COPY.fields])
            try:
                versions.publish(spark, table, ready, base, (), str(batch), COPY_ORDER)
                return
            except versions.VersionConflict:  # compacted meanwhile
                continue

    return impressions.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint).foreachBatch(publish)

"""Parquet and JDBC tables with the declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlumen.schemas import TABLES

FACTS = ("impression", "impression_event", "click_event", "conversion_event", "ad_event")

MARKS = T.StructType([
    T.StructField("tenant_id", T.IntegerType()),
    T.StructField("at", T.StringType()),
    T.StructField("id", T.LongType()),
])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A declared table below ``root``. The schema is given, so no file is opened to plan."""
    schema = TABLES[name]
    if name in FACTS:
        schema = T.StructType(schema.fields + [T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              lower: int | None = None, upper: int | None = None,
              partitions: int | None = None) -> DataFrame:
    """A relational table, split over executors along its id when bounds are given."""
    if partitions is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column="id", lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def append_rows(rows: DataFrame, root: str, name: str) -> None:
    """Append to a declared table; facts are laid out by day.

    ``rebalance`` lets AQE size the files: a day with a third of all rows is
    split, and small days share a task. Rows are sorted by tenant and time
    within a file, so that its statistics prune.
    """
    declared = rows.select(*[
        F.col(field.name).cast(field.dataType) for field in TABLES[name].fields
    ])
    if name not in FACTS:
        declared.write.mode("append").parquet(f"{root}/{name}")
        return
    dated = declared.withColumn("date", F.to_date("timestamp"))
    laid = dated.hint("rebalance", "date").sortWithinPartitions("date", "tenant_id", "timestamp")
    laid.write.partitionBy("date").mode("append").parquet(f"{root}/{name}")


def overwrite_days(rows: DataFrame, path: str) -> None:
    """Replace the days that occur in ``rows`` (column ``date``) and leave all others."""
    rows.hint("rebalance", "date").write.option("partitionOverwriteMode", "dynamic").partitionBy(
        "date"
    ).mode("overwrite").parquet(path)


def write_version(rows: DataFrame, path: str) -> None:
    """Write a complete new version of a table to a path not used before.

    Readers keep the old version until the caller points them to the new one;
    a failed write leaves nothing behind that is in use.
    """
    rows.write.mode("errorifexists").parquet(path)


def read_if_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``; no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_mark(spark: SparkSession, path: str, tenant_id: int):
    """The tenant's latest sync mark as (text time in UTC, id), or None."""
    marks = read_if_any(spark, path, MARKS).filter(F.col("tenant_id") == tenant_id)
    latest = marks.agg(F.max(F.struct("at", "id")).alias("mark")).first()["mark"]
    return None if latest is None else (latest["at"], latest["id"])


def write_mark(spark: SparkSession, path: str, tenant_id: int, at: str, row_id: int) -> None:
    """Append the tenant's new sync mark."""
    spark.createDataFrame([(tenant_id, at, row_id)], MARKS).coalesce(1).write.mode(
        "append"
    ).parquet(path)

"""What several operators share: stored tables and the texts they read."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlumen.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the driver ends in order."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session is over and took its JVM with it
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and written to the shared folder as Parquet.

    Later reads agree with each other, prune columns, and do not depend on
    the executors that computed it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete ``stored`` tables whose last reader has been written."""
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            _remove(table.sparkSession, path)


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """The names, lengthened where ``docs`` has a column of that name in any case."""
    taken = {name.lower() for name in docs.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")

"""Numbering along an order, for keys of any size.

A plain window gathers each key in one task. That is fine where a key is known
to be small (days of a campaign), but one campaign may own a third of an event
log. Here the rows are cut into even pieces along (key, order) instead; a key
spreads over as many pieces as it needs, and only one summary row per key and
piece has to be looked at together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.session import settle


def pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` in even sorted pieces: ``_piece`` tells which, ``_at`` where in it.

    ``order`` must end in a unique column; then no two rows tie and the range
    bounds can split any key. The result is settled because both passes over
    it must see the same pieces.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    along = [*keys, *order]
    placed = (
        df.repartitionByRange(count, *along)
        .sortWithinPartitions(*along)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The id holds the partition in its upper bits and the row in the lower 33.
    return settle(placed.withColumn("_piece", F.shiftright("_at", 33).cast("int")))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str,
                last: DataFrame | None = None) -> DataFrame:
    """Consecutive numbers per key along ``order``, from 1.

    ``last`` (keys and a column ``last``) gives numbers already used; counting
    goes on from there.
    """
    laid = pieces(df, keys, order)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = laid.groupBy(*keys, "_piece").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if last is not None:
        runs = runs.join(last.select(*keys, "last"), keys, "left")
        runs = runs.withColumn("_before", F.col("_before") + F.coalesce("last", F.lit(0)))
    runs = runs.select(*keys, "_piece", "_first", "_before")
    # One row per key and piece, from the settled pieces. Broadcast while they are few, the rows
    # stay where they lie.
    numbered = laid.join(lookup_side(runs), [*keys, "_piece"])
    number = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return numbered.select(*df.columns, number.alias(name))


"""Sharding by longest processing time.

Groups that must stay together (equal texts) are items with a size. Items,
largest first, go to the least loaded shard, found through a heap.

Only a bounded number of items reaches the heap. A group of at least
``total / (shards * bundles)`` bytes is an item of its own, so there are at
most ``shards * bundles`` of these; all smaller groups are bundled by the hash
of their text into ``shards * bundles`` further items. A shard is therefore
off the mean by about one bundle, or by what one giant group forces.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.llm.common import partitions, stored, text_of

RECORD_BYTES = 16  # added to each text for what a record costs beside it


def longest_first(items: list[tuple], shards: int) -> dict:
    """Shard of each ``(name, size)``: by falling size, ties by name, to the least load."""
    heap = [(0, shard) for shard in range(shards)]
    place = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        place[name] = shard
    return place


def _items(rows: DataFrame, cut: float) -> DataFrame:
    """(key or null, bundle, size): groups of ``cut`` bytes and more, and bundles of the rest."""
    groups = rows.groupBy("key", "bundle").agg(F.sum("size").alias("size"))
    own: Column = F.when(F.col("size") >= cut, F.col("key"))
    return groups.groupBy(own.alias("key"), "bundle").agg(F.sum("size").alias("size"))


def shard_documents(docs: DataFrame, shards: int = 40, bundles: int = 512,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its ``shard`` and its ``slot`` there.

    Columns: the id, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law``
    (``bytes``: shard sizes are near equal), ``shard``, ``slot`` (gapless from
    0 in each shard) and ``grown_shard`` (null under this law).

    Null texts count as empty. Rows of equal text share a shard, however many
    there are; repeated rows each take a slot. Null ids are kept. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    most = shards * bundles
    text = text_of(text_column)
    rows = stored(docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        F.pmod(F.xxhash64(text), F.lit(most)).cast("int").alias("bundle"),
    ), "shard-rows")

    total = rows.agg(F.sum("size")).first()[0] or 0
    # At most 2 * most rows, whatever the size of the table.
    items = _items(rows, total / most).collect()
    place = longest_first(
        [((row.bundle, bytes(row.key) if row.key else b""), row.size) for row in items], shards)
    alone = spark.createDataFrame(
        [(bytearray(key), shard) for (_, key), shard in place.items() if key],
        "key binary, own_shard int")
    bundled = spark.createDataFrame(
        [(bundle, shard) for (bundle, key), shard in place.items() if not key],
        "bundle int, bundle_shard int")
    placed = (
        rows.join(F.broadcast(alone), "key", "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .select("id", "size", "text_crc32",
                F.coalesce("own_shard", "bundle_shard").alias("shard"),
                F.pmod(F.xxhash64("id"), F.lit(partitions(spark))).cast("int").alias("piece"))
    )
    return _numbered(placed).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(placed: DataFrame) -> DataFrame:
    """Slots: rows are numbered within (shard, piece), pieces by running totals of counts."""
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row for each shard and piece: shards * shuffle partitions.
    starts = placed.groupBy("shard", "piece").agg(F.count("*").alias("rows")).select(
        "shard", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "piece"]).withColumn(
        "slot", (F.col("start") + F.col("at")).cast("bigint"))

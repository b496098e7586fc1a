"""Exact deduplication by a content sort.

Texts are normalised, dealt out by sampled splitters along (start of the
text, hash of the text), sorted on the whole text within each range, and each
is compared in full with its neighbour. Only built-in functions.

Copies of one text may be a third of the table. Hashes that hold more than a
tenth of a mean range are counted first (a hash aggregate, merged map-side);
the copies of such a text are spread over several ranges by a salt from
their id, and the few runs that result are joined by digest afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.llm.common import partitions, stored, text_of

BLANKS = "[\\x20\\x09-\\x0D]+"
# The same result as replacing BLANKS by a space, but single spaces are left alone.
_UNEVEN_BLANKS = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"
# Characters that, with the hash, place a text among the ranges.
LEAD = 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _UNEVEN_BLANKS, " ")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                carry: list[str] = ()) -> DataFrame:
    """Every row with what becomes of it: ``keep_id, group_size, kept, text_sha256``.

    Null texts are empty, and all empty texts are copies of each other. The
    smallest id stays (null ids last); of repeated rows with that id exactly
    one stays. ``carry`` names columns to hand through as a struct ``carried``.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = partitions(spark)
    rows = docs.select(
        F.col(id_column).alias("id"), normalised(text_of(text_column)).alias("t"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    ).withColumn("lead", F.substring("t", 1, LEAD)).withColumn("h", F.xxhash64("t"))

    # No more than 10 * ranges hashes can pass the limit.
    limit = docs.count() / (10 * ranges)
    heavy = rows.groupBy("h").agg(F.count("*").alias("copies")).filter(
        (F.col("copies") > limit) & (F.col("copies") > 1))
    salts = F.coalesce(F.ceil(F.col("copies") / F.lit(limit or 1)), F.lit(1))
    dealt = (
        rows.join(F.broadcast(heavy), "h", "left").withColumn("salts", salts)
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
        .repartitionByRange(ranges, "lead", "h", "salt")
    )
    place = ["lead", "h", "salt"]
    order = Window.partitionBy(*place).orderBy("t", F.asc_nulls_last("id"))
    first = ~F.col("t").eqNullSafe(F.lag("t").over(order))
    runs = (
        dealt.withColumn("first", first)
        .withColumn("run", F.sum(F.col("first").cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("sha", F.unhex(F.sha2("t", 256))).drop("t")
    )
    run = Window.partitionBy(*place, "run")
    marked = stored(runs.select(
        "id", "sha", "first", "salts", F.min("id").over(run).alias("head"),
        F.count("*").over(run).alias("rows"), *(["carried"] if carry else []),
    ), "copies")

    # Runs of salted texts: at most salts, so some 20 * ranges rows in all.
    joined = marked.filter(F.col("first") & (F.col("salts") > 1)).groupBy("sha").agg(
        F.min("head").alias("keep"), F.sum("rows").alias("all_rows"))
    keep_id = F.when(F.col("all_rows").isNotNull(), F.col("keep")).otherwise(F.col("head"))
    return marked.join(F.broadcast(joined), "sha", "left").select(
        F.col("id").alias(id_column), keep_id.alias("keep_id"),
        F.coalesce("all_rows", "rows").alias("group_size"),
        (F.col("first") & F.col("head").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), *(["carried"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns: of equal texts one, null and empty alike."""
    marked = mark_copies(docs, id_column, text_column, docs.columns)
    return marked.filter("kept").select("carried.*")

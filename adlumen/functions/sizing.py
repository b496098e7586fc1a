"""Broadcasts behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup of this many rows and three numbers takes some 50 MB per executor.
BROADCAST_ROWS = 1_000_000


def lookup_side(lookup: DataFrame, bounded_by: DataFrame | None = None,
                rows: int = BROADCAST_ROWS) -> DataFrame:
    """``lookup`` marked for broadcast if it is known to be small enough.

    The size is counted before the facts are touched, since Spark's own
    estimate of a joined lookup is a product of sizes and would have it
    shuffle the facts. ``bounded_by`` is a table that has at least as many
    rows and is cheaper to count: for a plain Parquet table, file footers
    suffice. A larger lookup is left to the shuffle join, where AQE splits
    the hot keys.
    """
    counted = lookup if bounded_by is None else bounded_by
    return F.broadcast(lookup) if counted.count() <= rows else lookup

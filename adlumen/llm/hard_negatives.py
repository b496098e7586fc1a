"""Hard negatives: rows of another label that score nearly as high as a positive.

The rows are dealt by label into blocks of bounded size, each stored with its
cover tree (``cover_tree``). The anchors are a stated query set; they are taken
in slices of bounded size, and each slice is sent to all trees, so the rows
never move again. Per slice, a first search finds the positives in the trees
of the anchor's own label; their scores give the windows for the second search
in all other trees. A task hands on no more than the first rows of each search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.llm import cover_tree
from adlumen.llm.common import scratch_path, stored
from adlumen.llm.cover_tree import LONG, Best, CoverTree

SCALE = 256
LABELS = 10
MOVED_EVERY, ANCHOR_EVERY = 7, 100
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT, BASE_PERCENT = 30, 90, 100

BLOCK_ROWS = 2048
# Anchors sent out together, and how many of them a task works on at a time.
SLICE, BATCH = 8192, 256


def whole_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                  label_column: str = "label") -> DataFrame:
    """The rows that take part, as ``id, label, vector``, labels already moved.

    A null id, label or vector and any null or non-finite component exclude a row.
    """
    rows = table.select(F.col(id_column).cast("long").alias("id"),
                        F.col(label_column).cast("long").alias("label"),
                        F.col(vector_column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    moved = F.when(F.col("id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(
        F.col("label"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & good).withColumn(
        "label", moved)


def _matrix(vectors: list) -> np.ndarray:
    """Lines of whole components; shorter vectors end in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), max(width, 1)))
    for line, vector in enumerate(vectors):
        out[line, : len(vector)] = vector
    return np.floor(SCALE * out)


_ARRAYS = ("ids", "vectors", "center", "start", "end", "parent", "radius", "leaf")
_TREES = "label long, width int, wide boolean, " + ", ".join(f"{n} binary" for n in _ARRAYS)
_KINDS = {"ids": np.int64, "center": np.int32, "start": np.int32, "end": np.int32,
          "parent": np.int32, "radius": np.float64, "leaf": np.bool_}


def _planted(rows: pa.Table) -> pa.Table:
    """One block as a tree in one row."""
    vectors = _matrix(rows["vector"].to_pylist())
    tree = cover_tree.build(rows["id"].to_numpy(), vectors)
    wide = bool(np.abs(vectors).max() >= 2.0 ** 15)
    row = {name: np.ascontiguousarray(getattr(tree, name).astype(kind)).tobytes()
           for name, kind in _KINDS.items()}
    row["vectors"] = tree.vectors.astype(np.float64 if wide else np.int16).tobytes()
    row |= {"label": rows["label"][0].as_py(), "width": vectors.shape[1], "wide": wide}
    kinds = {"label": pa.int64(), "width": pa.int32(), "wide": pa.bool_()}
    return pa.table({name: pa.array([row[name]], kinds.get(name, pa.binary()))
                     for name in ("label", "width", "wide", *_ARRAYS)})


def _read(row: dict) -> CoverTree:
    parts = {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()}
    raw = np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.int16)
    return CoverTree(vectors=raw.astype(np.float64).reshape(-1, row["width"]), **parts)


def plant_trees(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``whole_vectors`` in blocks of one label, a cover tree each."""
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).alias("parts"))
    dealt = rows.join(lookup_side(sizes), "label").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    return stored(dealt.groupBy("label", "part").applyInArrow(_planted, _TREES), "trees")


_FOUND = pa.schema([("search", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _searched(anchors: pd.DataFrame, wanted: pd.DataFrame, k: int, same_label: bool):
    """Searches of a slice: ``wanted`` has anchor (place in ``anchors``), low, high."""
    matrix = _matrix(anchors["vector"].tolist())
    ids, labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    of, low, high = (wanted[c].to_numpy() for c in ("anchor", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[np.ndarray, np.ndarray, Best]] = {}
        # Batches of anchors of one label: a tree then concerns all of a batch or none.
        for label in np.unique(labels):
            members = np.flatnonzero(labels == label)
            for at in range(0, len(members), BATCH):
                some = members[at : at + BATCH]
                mine = np.flatnonzero(np.isin(of, some))
                if len(mine):
                    own = Best(np.searchsorted(some, of[mine]), low[mine], high[mine], k)
                    kept[int(label), at] = (some, mine, own)
        for batch in batches:
            for row in batch.to_pylist():
                tree = _read(row)
                for (label, _), (some, _, own) in kept.items():
                    if (label == row["label"]) == same_label:
                        cover_tree.search(tree, matrix[some], ids[some], own, same_label)
        for _, mine, own in kept.values():
            if len(own.search):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[own.search]), pa.array(own.id), pa.array(own.score.tolist(), pa.int64())],
                    schema=_FOUND)

    return run


def _first(trees: DataFrame, anchors: pd.DataFrame, wanted: pd.DataFrame, k: int,
           same_label: bool) -> DataFrame:
    found = trees.mapInArrow(_searched(anchors, wanted, k, same_label),
                             "search long, id long, score long")
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, "
           "positive_score long, negative_score long")


def mine_hard_negatives(table: DataFrame, id_column: str = "vec_id",
                        vector_column: str = "embedding", label_column: str = "label",
                        block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE) -> DataFrame:
    """For each anchor and positive, the first ten negatives in the positive's window.

    Rows with a null id take no part, like those without a label or a whole
    vector. A shorter vector ends in zeros. Repeated rows are rows of their
    own, but a row with the anchor's id is not its positive. Scores are exact;
    one beyond 64 bits counts as the greatest of them. An empty table gives an empty result; other columns
    are ignored whatever their names.
    """
    spark = table.sparkSession
    rows = whole_vectors(table, id_column, vector_column, label_column)
    trees = plant_trees(rows, block_rows)
    asked = rows.filter(F.col("id") % ANCHOR_EVERY == 0)
    slices = -(-asked.count() // slice_rows)
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], _RESULT).write.parquet(path)
    for part in range(slices):
        anchors = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == part).toPandas()
        if len(anchors):
            _mine_slice(spark, trees, anchors).write.mode("append").parquet(path)
    return spark.read.schema(_RESULT).parquet(path)


def _mine_slice(spark, trees: DataFrame, anchors: pd.DataFrame) -> DataFrame:
    anchors = anchors.sort_values("id", kind="stable", ignore_index=True)
    any_score = pd.DataFrame({"anchor": np.arange(len(anchors)), "low": -LONG, "high": LONG})
    positives = _first(trees, anchors, any_score, POSITIVES, True).toPandas()
    score = [int(s) for s in positives["score"]]
    wanted = pd.DataFrame({
        "anchor": positives["search"],
        "low": np.array([-(-LOW_PERCENT * s // BASE_PERCENT) for s in score], np.int64),
        "high": np.array([HIGH_PERCENT * s // BASE_PERCENT for s in score], np.int64)})
    pairs = pd.DataFrame({
        "search": np.arange(len(positives)), "positive_id": positives["id"],
        "anchor_id": anchors["id"].to_numpy()[positives["search"]],
        "positive_score": positives["score"]}).astype("int64")
    negatives = _first(trees, anchors, wanted, NEGATIVES, False)
    # As many rows as the slice has positives.
    listed = F.broadcast(spark.createDataFrame(
        pairs, "search long, positive_id long, anchor_id long, positive_score long"))
    return negatives.join(listed, "search").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

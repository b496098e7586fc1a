"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``span`` bytes that covers it starts anywhere else.

Sorting the suffixes at all bytes is not needed. In each window of ``span`` bytes
the gram with the least hash is its anchor; equal windows have equal anchors at
equal offsets, so only anchors are sorted, by what follows and, in a second
sort, by what precedes. Anchors whose whole surroundings repeat are settled by
counting, which also takes care of copies, however many. The others whose gram
occurs again are sorted: tasks exchange front-coded sorted runs by sampled
ranges, and loser trees merge them, keeping common prefixes. Neighbours in the
two orders tell which windows of an anchor repeat. Their common prefixes also
bound what any other anchor could add; where that is more than the neighbours
show, those windows are counted one by one, and of anchors that stand together
and share a window only the first counts it.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlumen.llm.common import forget, partitions, stored, text_of
from adlumen.llm.suffix_runs import LoserTree, common, front_coded

SPAN = 400
_TURN = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 30) - 1)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    back = pow(int(_TURN), -1, 1 << 64)
    up, down = np.full(size, _TURN, np.uint64), np.full(size, back, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place."""
    size = len(data) + 1
    up, down = _powers(1 << max(16, size.bit_length()))
    sums = np.zeros(size, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:size - 1],
              out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[:size - gram]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least gram of each window of ``span`` bytes, rightmost of equals; hashes."""
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    width, count = span - gram + 1, len(hashes)
    ranked = (hashes & ~_PLACE) | (_PLACE - np.arange(count, dtype=np.uint64))
    padded = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count - width + 1], ahead[width - 1:count])
    places = np.unique(_PLACE - (least & _PLACE)).astype(np.int64)
    return places, hashes[places]


def _anchor_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, h, at, gram, around): each anchor with digests of its gram and its surroundings."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, h bigint, at int, gram bigint, " \
             "around binary, enough boolean"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                row, at, grams, around, enough = [], [], [], [], []
                for k, text in enumerate(some.column(2).to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    places, hashes = anchors(data, span, gram)
                    row.append(np.full(len(places), k))
                    at.append(places)
                    grams.append(hashes)
                    for p in places.tolist():
                        start, end = max(0, p - span + gram), min(len(data), p + span)
                        around.append(hashlib.blake2b(
                            data[start:end], digest_size=16,
                            salt=(p - start).to_bytes(4, "little")).digest())
                        enough.append(end - start >= span)
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(take), some.column(1).take(take),
                    pa.array(np.concatenate(at).astype(np.int32)),
                    pa.array(np.concatenate(grams).view(np.int64)),
                    pa.array(around, pa.binary()), pa.array(enough, pa.bool_()),
                ], names=["id", "h", "at", "gram", "around", "enough"])

    return docs.select("id", "h", "t").mapInArrow(found, schema)


def _surroundings(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """``wanted`` anchors (wid, wh, at, ...) with the bytes ``ahead`` and, reversed, ``behind``."""
    end = F.col("at") + 1
    data = F.col("t").cast("binary")
    start = F.greatest(F.lit(0), F.col("at") - (span - gram))
    joined = docs.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")))
    # Repeated rows give the same bytes; one is enough.
    cut = joined.select("wid", "wh", "at", "gram", "own",
                        F.substring(data, end, F.lit(span)).alias("ahead"),
                        F.substring(data, start + 1, F.col("at") - start).alias("before"))
    return cut.dropDuplicates(["wid", "wh", "at"]).withColumn(
        "pid", F.monotonically_increasing_id())


_LENGTHS = Struct("<HH")


def _keys(rows: pa.RecordBatch, span: int, back: int, forward: bool) -> list[tuple[bytes, int]]:
    """Sort keys with their ids: what follows, then what precedes, or the other way round.

    Both are padded to full length; the real lengths stand at the end of the key.
    """
    out = []
    for pid, ahead, before in zip(*(rows.column(k).to_pylist() for k in range(3))):
        a, b = ahead.ljust(span, b"\0"), before[::-1].ljust(back, b"\0")
        lengths = _LENGTHS.pack(len(ahead), len(before))
        out.append(((a + b if forward else b + a) + lengths, pid))
    return out


NEIGHBOURS = "pid bigint, ahead int, behind int, low int, high int, second boolean"


def _compare(one: tuple[bytes, int], other: tuple[bytes, int], known: int, span: int, back: int,
             forward: bool) -> list[tuple]:
    """What two neighbours, of which ``known`` bytes agree, say of each other.

    ``ahead`` or ``behind``, by the order, bounds what either shares with any
    anchor; ``low`` to ``high`` are the offsets of the windows the two share.
    ``second`` tells that the other one stands before.
    """
    (a, p), (b, q) = one, other
    cut = span if forward else back
    first = min(known, cut)
    second = common(a[cut:span + back], b[cut:span + back], max(0, known - cut))
    ahead, behind = (first, second) if forward else (second, first)
    sizes = _LENGTHS.unpack(a[span + back:]), _LENGTHS.unpack(b[span + back:])
    low = span - min(ahead, sizes[0][0], sizes[1][0])
    high = min(behind, sizes[0][1], sizes[1][1])
    bound = (ahead, None) if forward else (None, behind)
    return [(p, *bound, low, high, False), (q, *bound, low, high, True)]


def _sorted_neighbours(rows: DataFrame, span: int, gram: int,
                       forward: bool) -> tuple[DataFrame, DataFrame]:
    """What each anchor of ``rows`` learns from its neighbours in one of the two orders.

    Comes with the stored table it is read from.
    """
    spark, back = rows.sparkSession, span - gram
    ranges = partitions(spark)
    keys = rows.select("pid", "ahead", "before")
    # Some eight keys for each range, chosen by hash, give the splitters.
    part = max(1, rows.count() // (8 * ranges))
    sample = keys.filter(F.pmod(F.xxhash64("pid"), F.lit(part)) == 0).limit(16 * ranges)
    drawn = sorted(key for batch in sample.toArrow().to_batches()
                   for key, _ in _keys(batch, span, back, forward))
    step = max(1, len(drawn) // ranges)
    splitters = drawn[step::step]

    def as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sorted(e for batch in batches for e in _keys(batch, span, back, forward))
        edges = [bisect_left(entries, (key,)) for key in splitters]
        parts = [(k, entries[i:j]) for k, (i, j) in enumerate(pairwise([0, *edges, len(entries)]))
                 if i < j]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in parts], pa.int32()),
             pa.array([front_coded(part) for _, part in parts], pa.binary())],
            names=["target", "run"])

    def merged(target: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out, first, last = [], None, None
        for key, pid, known in LoserTree(frame["run"].tolist()):
            now = (key, pid)
            if last is None:
                first = now
            else:
                out += [(*told, None) for told in _compare(last, now, known, span, back, forward)]
            last = now
        out += [(pid, None, None, None, None, None, key) for key, pid in (first, last)]
        table = pd.DataFrame(out, columns=["pid", "ahead", "behind", "low", "high", "second",
                                           "key"], dtype=object)
        return table.assign(target=int(target[0]))

    told = stored(keys.mapInArrow(as_runs, "target int, run binary").groupBy("target")
                  .applyInPandas(merged, f"{NEIGHBOURS}, key binary, target int"), "neighbours")
    # Two keys for each range: the last of one range meets the first of the next.
    ends = sorted((row.target, bytes(row.key), row.pid) for row in
                  told.filter("key is not null").select("target", "key", "pid").collect())
    across = [found for (t, a, p), (u, b, q) in pairwise(ends) if t != u
              for found in _compare((a, p), (b, q), common(a, b), span, back, forward)]
    return told.filter("key is null").drop("key", "target").unionByName(
        spark.createDataFrame(across, NEIGHBOURS)), told


def _found_again(counted: DataFrame) -> DataFrame:
    """The ``open`` windows (d, w) that are there more than once.

    All are counted, but what neighbours have shown needs no second answer.
    """
    again = counted.groupBy("d", "w").agg(
        F.count("*").alias("n"), F.max("open").alias("any")).filter("n > 1 and any")
    return counted.filter("open").join(again.select("d", "w"), ["d", "w"])


def _met_anchors(rows: DataFrame, told: list[DataFrame], span: int) -> DataFrame:
    """Anchors of which a window may repeat, with what neighbours tell of them.

    ``span_low`` to ``span_high`` are the offsets d of such windows: d bytes before
    the anchor, the rest from it on. ``led`` are those shared with the neighbour before.
    """
    forward, backward = told
    of = rows.select("pid", "wid", "wh", "at", "gram", "own", "ahead", "before",
                     F.octet_length("ahead").alias("la"), F.octet_length("before").alias("lb"))
    summed = forward.unionByName(backward).groupBy("pid").agg(
        F.max("ahead").alias("most_ahead"), F.max("behind").alias("most_behind"),
        F.collect_list(F.struct("low", "high")).alias("shown"),
        F.collect_list(F.when(F.col("second"), F.struct(
            "low", "high", F.col("ahead").isNotNull().alias("forward")))).alias("led"))
    return of.join(summed, "pid").withColumn(
        "span_low", F.lit(span) - F.least("most_ahead", "la")).withColumn(
        "span_high", F.least("most_behind", "lb")).filter("span_low <= span_high")


def _unseen(d: Column) -> Column:
    """Whether no neighbour has shown the window at offset ``d``."""
    return ~F.exists("shown", lambda s: (s["low"] <= d) & (d <= s["high"]))


def _counted(met: DataFrame, asked: DataFrame, span: int, gram: int) -> DataFrame:
    """Windows at the offsets (gram, d) that are ``asked``, each from the first of its neighbours.

    What an anchor shares with the one before it in the order that d goes by is
    left to that one, and so on to the first of the run. Those that no neighbour
    shares are all there, and next to them at least one for any others like them.
    """
    d = F.col("d")
    led = F.exists("led", lambda s: (s["low"] <= d) & (d <= s["high"])
                   & (s["forward"] == (2 * d <= span - gram)))
    window = F.concat(F.expr("substring(before, lb - d + 1, d)"),
                      F.expr(f"substring(ahead, 1, {span} - d)"))
    return met.join(asked, "gram").filter(
        (d >= F.col("span_low")) & (d <= F.col("span_high")) & ~led).select(
        "pid", "wid", "wh", "at", "own", "d", F.sha2(window, 256).alias("w"),
        (F.col("own") & _unseen(d)).alias("open"))


def _repeated_windows(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """(wid, wh, start, stop): bytes around anchors whose windows repeat around another one.

    ``rows`` is a stored table and deleted once it has been read.
    """
    (ahead, forward), (behind, backward) = (
        _sorted_neighbours(rows, span, gram, way) for way in (True, False))
    low, high = F.col("span_low"), F.col("span_high")
    met = stored(_met_anchors(rows, [ahead, behind], span), "met-anchors")
    forget(forward, backward, rows)
    inside = F.transform("shown", lambda s: F.struct(
        F.greatest(s["low"], low).alias("low"), F.least(s["high"], high).alias("high")))
    shown = met.withColumn("part", F.explode(inside)).filter(
        (F.col("part.low") <= F.col("part.high"))).select(
        "pid", "wid", "wh", "at", "own", F.col("part.low").alias("low"),
        F.col("part.high").alias("high"))

    asked = met.filter("own").select("gram", F.explode(F.filter(
        F.sequence(low, high), _unseen)).alias("d")).distinct()
    counted = _counted(met, asked, span, gram)
    more = _found_again(counted).select(
        "pid", "wid", "wh", "at", "own", F.col("d").alias("low"), F.col("d").alias("high"))
    windows = stored(shown.unionByName(more).filter("own").select(
        "wid", "wh", (F.col("at") - F.col("high")).alias("start"),
        (F.col("at") - F.col("low") + span).alias("stop")), "windows")
    forget(met)
    return windows


REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int | None = None,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes.

    Texts are UTF-8 bytes (null: none) and matches never cross texts. A repeated
    row repeats all its strings of ``span`` bytes. ``spans`` lists the maximal
    removed runs. Texts shorter than ``span`` stay whole. An empty table gives
    an empty result; other columns are ignored.
    """
    gram = gram or span // 2
    text = text_of(text_column)
    docs = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    found = stored(_anchor_rows(docs, span, gram), "anchors")
    around = found.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "h", "at", "enough")).alias("one"))
    grams = around.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    kinds = stored(around.join(grams.filter("all > 1"), "gram"), "anchor-kinds")
    settled = stored(found.filter("enough").join(
        kinds.filter("n > 1").select("gram", "around"), ["gram", "around"]).select(
        F.col("id").alias("wid"), F.col("h").alias("wh"),
        F.greatest(F.lit(0), F.col("at") - (span - gram)).alias("start"),
        (F.col("at") + span).alias("stop")), "settled")
    forget(found)
    wanted = kinds.filter("kinds > 1").select(
        F.col("one.id").alias("wid"), F.col("one.h").alias("wh"), F.col("one.at").alias("at"),
        "gram", (F.col("n") == 1).alias("own"))
    rows = stored(_surroundings(docs, wanted, span, gram), "surroundings")
    forget(kinds)
    windows = _repeated_windows(rows, span, gram)
    spans = stored(settled.unionByName(windows).groupBy("wid", "wh").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    forget(settled, windows)

    @F.pandas_udf(f"{REMOVED}, spans array<struct<start:int,stop:int>>, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, parts in zip(texts, spans):
            data = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for start, stop in sorted((p["start"], min(p["stop"], len(data)))
                                      for p in (parts if parts is not None else ())):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            edges = [0, *(e for run in runs for e in run), len(data)]
            kept = b"".join(data[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2))
            out.append((len(data), len(data) - len(kept), len(runs),
                        hashlib.sha256(kept).hexdigest(),
                        [{"start": s, "stop": e} for s, e in runs], kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256",
                                          "spans", "kept"])

    joined = docs.join(spans, F.col("id").eqNullSafe(F.col("wid"))
                       & (F.col("h") == F.col("wh")), "left")
    return joined.select(F.col("id").alias(id_column), cut("t", "spans").alias("c")).select(
        id_column, "c.*")

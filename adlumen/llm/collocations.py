"""Phrases mined by direct-address tiles.

Words are ranked by frequency within their language, so that frequent ones
have small numbers. Neighbouring numbers (i, j) address a cell of a matrix cut
into square tiles: in a tile with many pairs the cells are counted directly
(``numpy.bincount``), in a sparse one the pairs are sorted as coordinates.
The pairs that are frequent are ranked anew, and the same step on neighbouring
pairs counts phrases of three words, then of four: a phrase is frequent only
if both of its shorter ends are, so nothing frequent is missed.

Texts are turned once into blocks of numbers, each of one language and of
bounded size, with the block's own dictionary. All that is global (counts,
ranks, what a block's number stands for) is grouped, numbered and joined by
Spark; a block learns only about what occurs in it. No dictionary has to fit
into a task or the driver, and a hot language is many blocks.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlumen.functions.ordered import number_rows
from adlumen.functions.sizing import lookup_side
from adlumen.llm.common import forget, partitions, stored, text_of

LEAST = 30
LONGEST = 4
TOP = 2000
INSIDE_PERCENT = 80
SCALE = 2_000_000
UNKNOWN = "und"

TILE = 1024
# Words of a block, and of a row of it: some ten bytes each while they are gathered, then four.
BLOCK_WORDS, PART_WORDS = 4_000_000, 300_000
# Distinct pairs of a task that are put together before they are handed on.
HELD_PAIRS = 250_000
# Words of the texts for each bucket in which pairs are looked up.
BUCKET_WORDS = 4_000_000

_TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
_BREAKS = np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8)


# -- within a task -----------------------------------------------------------

class _Block:
    """Words of one language as they come, in Arrow's compact form; texts end in a break."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] = []
        self.ends: list[int] = []
        self.words = 0

    def add(self, text: str) -> None:
        found = _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())
        found.append(b".")
        self.parts.append(pa.array(found, pa.binary()))
        self.words += len(found)
        self.ends.append(self.words)

    def rows(self, lang: str, part: int) -> Iterator[pa.RecordBatch]:
        """Numbers of the words, 0 for a break, in rows of some ``part``; the last has the dictionary."""
        coded = pa.concat_arrays(self.parts).dictionary_encode()
        self.parts = []
        known = coded.dictionary
        starts = np.frombuffer(known.buffers()[1], np.int32, len(known) + 1, known.offset * 4)[:-1]
        word = ~np.isin(np.frombuffer(known.buffers()[2], np.uint8)[starts], _BREAKS)
        numbers = np.where(word, np.cumsum(word), 0).astype(np.int32)
        codes = numbers[coded.indices.to_numpy()]
        counts = np.bincount(codes, minlength=int(word.sum()) + 1)[1:]
        words = known.filter(pa.array(word)).cast(pa.string())
        name, begin = uuid.uuid4().int >> 65, 0
        for end in self.ends:
            if end - begin >= part or end == self.words:
                last = end == self.words
                listed = [words, pa.array(counts)] if last else [None, None]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name], pa.int64()), pa.array([lang], pa.string()),
                    *(pa.nulls(1, kind) if x is None else pa.ListArray.from_arrays([0, len(x)], x)
                      for x, kind in zip(listed, _BLOCK_TYPES[2:4])),
                    pa.array([codes[begin:end].tobytes()], pa.binary()),
                ], names=["block", "lang", "words", "counts", "codes"])
                begin = end


_BLOCKS = "block long, lang string, words array<string>, counts array<long>, codes binary"
_BLOCK_TYPES = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]


def _tokenised(limit: int, part: int = PART_WORDS):
    """Texts into blocks; those not yet full at the end of the task go out as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = defaultdict(_Block)
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = blocks[lang]
                held -= block.words
                block.add(text.as_py())
                held += block.words
                if held >= limit:  # over all languages: any number of them stays bounded
                    largest = max(blocks, key=lambda name: blocks[name].words)
                    held -= blocks[largest].words
                    yield from blocks.pop(largest).rows(largest, part)
                    pa.default_memory_pool().release_unused()
        for lang in list(blocks):
            yield from blocks.pop(lang).rows(lang, part)
        # The worker lives on, with other tasks to come.
        pa.default_memory_pool().release_unused()

    return run


def tile_counts(codes: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring numbers as keys ``left << 32 | right`` in order, with their counts.

    0 is no number: it separates. Pairs are dealt to tiles of ``tile`` by
    ``tile`` ranks; a tile with a pair for every eighth cell or more is counted
    by address, the others together by sorting their coordinates.
    """
    left, right = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
    real = (left > 0) & (right > 0)
    left, right = left[real], right[real]
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    across = int(right.max()) // tile + 1
    place = (left // tile) * across + right // tile
    # A tile worth an array of its own has many pairs, so there are few of them.
    names, sizes = np.unique(place, return_counts=True)
    dense = names[sizes >= tile * tile // 8]
    keys, counts = [], []
    sparse = np.ones(len(left), bool)
    for name in dense.tolist():
        here = place == name
        sparse &= ~here
        row, column = name // across * tile, name % across * tile
        cells = np.bincount((left[here] - row) * tile + right[here] - column,
                            minlength=tile * tile)
        full = np.flatnonzero(cells)
        keys.append((full // tile + row) << 32 | (full % tile + column))
        counts.append(cells[full])
    coordinates, rows = np.unique(left[sparse] << 32 | right[sparse], return_counts=True)
    keys, counts = np.concatenate([*keys, coordinates]), np.concatenate([*counts, rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def _pair_totals(tile: int):
    """Counts of all pairs, added up over the task's blocks as far as they fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            keys, counts = held.pop(lang)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some),
                     pa.array(counts[at : at + 100_000])], names=["lang", "key", "n"])

        for batch in batches:
            for name, codes in zip(batch.column(1), batch.column(2)):
                lang = name.as_py()
                found = tile_counts(np.frombuffer(codes.as_buffer(), np.int32), tile)
                held[lang] = _added([held[lang], found]) if lang in held else found
                while sum(len(keys) for keys, _ in held.values()) > HELD_PAIRS:
                    yield from out(max(held, key=lambda at: len(held[at][0])))
        for lang in list(held):
            yield from out(lang)

    return run


def _bucket(left, right, buckets: int):
    """Where a pair is answered; the same for numbers of Spark and of numpy."""
    return (left * 1_000_003 + right) % buckets


def _asked(buckets: int):
    """The distinct pairs of each block, once for all of its rows that the task has at hand.

    A row packs the pairs of one block that one bucket answers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (block, lang), keys in held.items():
                at = _bucket(keys >> 32, keys & 0xFFFFFFFF, buckets)
                order = np.argsort(at, kind="stable")
                names, starts = np.unique(at[order], return_index=True)
                parts = np.split(keys[order], starts[1:]) if len(names) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([block] * len(names), pa.int64()),
                     pa.array([lang] * len(names), pa.string()),
                     pa.array([part.tobytes() for part in parts], pa.binary())],
                    names=["bucket", "block", "lang", "keys"])
            held.clear()

        for batch in batches:
            for name, lang, codes in zip(*(batch.column(i) for i in range(3))):
                numbers = np.frombuffer(codes.as_buffer(), np.int32).astype(np.int64)
                real = (numbers[:-1] > 0) & (numbers[1:] > 0)
                keys = np.unique((numbers[:-1] << 32 | numbers[1:])[real])
                block = name.as_py(), lang.as_py()
                held[block] = np.union1d(held[block], keys) if block in held else keys
                if sum(map(len, held.values())) > HELD_PAIRS:
                    yield from out()
        yield from out()

    return run


_ANSWERS = pa.schema([("asker", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary())])


def _answered(known: pa.Table, asked: pa.Table) -> pa.Table:
    """For each row of a bucket's ``asked`` the pairs among them that are ``known``, and their ranks."""
    by_lang = {}
    for lang in known["lang"].unique():
        own = known.filter(pc.equal(known["lang"], lang))
        keys, ranks = own["key"].to_numpy(), own["rank"].to_numpy().astype(np.int32)
        order = np.argsort(keys)
        by_lang[lang.as_py()] = keys[order], ranks[order]
    out = []
    for block, lang, packed in zip(asked["block"], asked["lang"], asked["keys"]):
        if lang.as_py() not in by_lang:
            continue
        keys, ranks = by_lang[lang.as_py()]
        wanted = np.frombuffer(packed.as_buffer(), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        if hit.any():
            out.append({"asker": block.as_py(), "keys": wanted[hit].tobytes(),
                        "ranks": ranks[at[hit]].tobytes()})
    return pa.Table.from_pylist(out, schema=_ANSWERS)


_RECODED = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary())])


def _recoded(by_pairs: bool):
    """A block's numbers replaced by the new ranks of what they stand for, 0 where it is rare."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if by_pairs:
            keys = np.frombuffer(b"".join(answers["keys"].to_pylist()), np.int64)
            ranks = np.frombuffer(b"".join(answers["ranks"].to_pylist()), np.int32)
        else:
            keys, ranks = answers["key"].to_numpy(), answers["rank"].to_numpy().astype(np.int32)
        order = np.argsort(keys)
        keys, ranks = keys[order], ranks[order]
        out = []
        for row in blocks.to_pylist():
            codes = np.frombuffer(row["codes"], np.int32)
            asked = codes.astype(np.int64)
            if by_pairs:
                asked = asked[:-1] << 32 | asked[1:]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                fresh = np.where(keys[at] == asked, ranks[at], 0).astype(np.int32)
            else:
                fresh = np.zeros(len(asked), np.int32)
            # Zeros in a row say no more than one.
            keep = (fresh > 0) | np.append(True, fresh[:-1] > 0)
            out.append({"block": row["block"], "lang": row["lang"],
                        "codes": fresh[keep].tobytes()})
        return pa.Table.from_pylist(out, schema=_RECODED)

    return run


# -- between tasks -----------------------------------------------------------

def _ranked(counted: DataFrame, order: list[Column], least: int) -> DataFrame:
    """The frequent rows with their rank in their language, the most frequent first."""
    frequent = stored(counted.filter(F.col("a") >= least).withColumn("_rare", -F.col("a")),
                      "frequent")
    return number_rows(frequent, ["lang"], ["_rare", *order], "rank").drop("_rare")


def _recode(blocks: DataFrame, answers: DataFrame, by_pairs: bool) -> DataFrame:
    """``blocks`` in new ranks, those that came as ``answers`` to what each asked for."""
    both = blocks.select("block", "lang", "codes").groupBy("block").cogroup(
        answers.groupBy("asker"))
    return both.applyInArrow(_recoded(by_pairs), "block long, lang string, codes binary")


def _pair_answers(codes: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """The ranks of the pairs each block asks for, found by sorted keys in buckets of pairs."""
    asked = codes.mapInArrow(_asked(buckets), "bucket long, block long, lang string, keys binary")
    place = _bucket(F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), buckets)
    known = pairs.select(place.alias("bucket"), "lang", "key", "rank")
    return known.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
        _answered, "asker long, keys binary, ranks binary")


def mine_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang",
                 least: int = LEAST, longest: int = LONGEST, tile: int = TILE,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more in a language.

    Columns: ``lang, phrase`` (space-joined), ``words`` (their number), ``a``
    (occurrences), ``l, r`` (occurrences of the two parts at the cut with the
    lowest score, the first of equals), ``n`` (words of the language), ``score``
    and ``inside``, the occurrences of the most frequent longer phrase that
    holds this one with ``INSIDE_PERCENT`` of its occurrences or more, else null.

    A null language is ``und``; null and empty texts have no words. Repeated
    rows count each time. An empty table gives an empty result, and columns
    other than the two are ignored whatever their names. A text is held whole
    in one task, and belongs to one block however long it is.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                        text_of(text_column).alias("text"))
    blocks = stored(texts.mapInArrow(_tokenised(block_words), _BLOCKS), "blocks")

    listed = blocks.filter("words is not null").select(
        "block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry")
    ).select("block", "lang", (F.col("at") + 1).cast("long").alias("key"),
             F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    counted = listed.groupBy("lang", "word").agg(F.sum("n").alias("a"))
    words = stored(_ranked(counted, ["word"], least).select(
        "lang", "rank", F.array("word").alias("words"), "a", F.array().cast("array<long>")
        .alias("heads"), F.array().cast("array<long>").alias("tails"), F.col("word")), "words")
    totals = blocks.filter("words is not null").select("lang", F.aggregate("counts", F.lit(0).cast("long"),
                                               lambda x, y: x + y).alias("n"))
    totals = stored(totals.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    answers = listed.join(lookup_side(words.select("lang", "word", "rank")), ["lang", "word"]).select(
        F.col("block").alias("asker"), "key", "rank")
    codes = stored(_recode(blocks, answers, by_pairs=False), "codes")
    # As many pairs are asked for as there are words at most, so a bucket's are bounded.
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), n_words // BUCKET_WORDS)
    forget(blocks)
    level = words.drop("word")
    found = []
    for length in range(2, longest + 1):
        counted = codes.mapInArrow(_pair_totals(tile), "lang string, key long, n long")
        pairs = stored(_ranked(counted.groupBy("lang", "key").agg(F.sum("n").alias("a")),
                               ["key"], least), "pairs")
        grown = stored(_grown(pairs, level), "phrases")
        found.append(grown)
        if length < longest:
            later = stored(_recode(codes, _pair_answers(codes, pairs, buckets), by_pairs=True),
                           "codes")
            forget(codes)
            codes = later
        forget(pairs)
        level = grown
    forget(codes)
    return _scored(found, totals)


def _grown(pairs: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases one word longer, with the counts of their beginnings and ends."""
    left = level.select("lang", F.col("rank").alias("left"), F.col("words").alias("first"),
                        F.col("a").alias("left_a"), F.col("heads").alias("left_heads"))
    right = level.select("lang", F.col("rank").alias("right"), F.col("words").alias("second"),
                         F.col("a").alias("right_a"), F.col("tails").alias("right_tails"))
    both = pairs.withColumn("left", F.shiftright("key", 32)).withColumn(
        "right", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    joined = both.join(lookup_side(left), ["lang", "left"]).join(
        lookup_side(right), ["lang", "right"])
    return joined.select(
        "lang", "rank", F.concat("first", F.slice("second", -1, 1)).alias("words"), "a",
        F.concat("left_heads", F.array("left_a")).alias("heads"),
        F.concat(F.array("right_a"), "right_tails").alias("tails"), "left", "right")


def _scored(found: list[DataFrame], totals: DataFrame) -> DataFrame:
    out = None
    for place, level in enumerate(found):
        if place + 1 < len(found):
            longer = found[place + 1]
            ends = longer.select("lang", F.col("left").alias("rank"), "a").unionByName(
                longer.select("lang", F.col("right").alias("rank"), "a"))
            # What a longer one holds, those in between hold at least as often.
            above = ends.groupBy("lang", "rank").agg(F.max("a").alias("above"))
            level = level.join(above, ["lang", "rank"], "left")
        else:
            level = level.withColumn("above", F.lit(None).cast("long"))
        level = level.select("lang", "words", "a", "heads", "tails", "above")
        out = level if out is None else out.unionByName(level)

    def exact(value: Column) -> Column:
        return value.cast("decimal(20,0)")

    # The value is at most half of SCALE; the product before it may pass 64 bits.
    value = "cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div cast({parts} as decimal(20,0))"
    cuts = F.expr("transform(sequence(1, size(heads)), k -> named_struct('score', "
                  + value.format(scale=SCALE, parts="(heads[k - 1] + tails[k - 1])")
                  + ", 'k', k, 'l', heads[k - 1], 'r', tails[k - 1]))")
    inside = exact(F.col("above")) * 100 >= exact(F.col("a")) * INSIDE_PERCENT
    return out.withColumn("cut", F.array_min(cuts)).join(lookup_side(totals), "lang").select(
        "lang", F.array_join("words", " ").alias("phrase"),
        F.size("words").cast("long").alias("words"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
        F.when(inside, F.col("above")).alias("inside"))


def best_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language that no longer phrase holds, ranked.

    Higher scores come first, then more occurrences, then the phrase by its
    bytes. Spark keeps ``top`` rows per language and task before it shuffles.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.filter(F.col("inside").isNull()).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                         "n", "score")

"""Benchmark decontamination by winnowing.

Of every ``span - gram + 1`` consecutive word grams the least hash is kept, on
both sides. Any span of ``span`` words that a document shares with a benchmark
item holds the same grams on both sides and so the same least one: no shared
span is missed. Documents and items that share a fingerprint are then compared
word by word around it. Only built-in functions.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.llm.common import free_names, stored, text_of

# Words: digits, letters and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPAN, GRAM = 10, 5


def words(text: Column) -> Column:
    """Words of ``text``; only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase),
                                F.lit(WORD), F.lit(0))


def rough_words(text: Column) -> Column:
    """The same words with all letters lower-cased, which costs far less.

    One for one with ``words``, since no letter becomes a separator. The capital
    sigma, the one letter whose lower case depends on what stands around it, is
    replaced first; so equal words stay equal wherever they stand, and nothing
    is missed by looking for these first.
    """
    plain = F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(first: int, last: Column, make) -> Column:
    """``make(i)`` for i from ``first`` to ``last``; null if there is none."""
    some = F.transform(F.sequence(F.lit(first), last), make)
    return F.when(last >= first, some)


def grams(w: Column, size: int) -> Column:
    """Hash of each run of ``size`` words."""
    return _each(1, F.size(w) - size + 1, lambda i: F.xxhash64(F.slice(w, i, size)))


def fingerprints(g: Column, window: int) -> Column:
    """The least hash of each ``window`` consecutive grams, each once."""
    if window == 1:
        return F.array_distinct(g)
    return F.array_distinct(_each(1, F.size(g) - window + 1,
                                  lambda i: F.array_min(F.slice(g, i, window))))


def prints_of(w: Column, gram: int, window: int) -> Column:
    return let(grams(w, gram), lambda g: fingerprints(g, window))


def _positions(g: Column, wanted: Column) -> Column:
    """Where a gram is one of ``wanted``."""
    return F.filter(F.sequence(F.lit(1), F.size(g)),
                    lambda i: F.array_contains(wanted, F.element_at(g, i)))


def _item_prints(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(item, iw, f, q): each fingerprint of an item and the words where its gram begins."""
    return stored(items.select("item", "iw", F.inline(let(
        grams(F.col("ir"), gram),
        lambda g: F.transform(
            _positions(g, fingerprints(g, span - gram + 1)),
            lambda q: F.struct(F.element_at(g, q).alias("f"), q.alias("q")))))), "item-prints")


def _shared_prints(docs: DataFrame, printed: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, h, f, n): fingerprints shared with an item; and a row per document, with its words.

    The row per document has ``n``, the number of words, and the text's own hash as ``f``.
    """
    prints = lookup_side(printed.select("f", F.lit(True).alias("wanted")).distinct())
    each = let(rough_words(F.col("t")), lambda w: F.concat(
        F.array(F.struct(F.col("h").alias("f"), F.size(w).cast("bigint").alias("n"))),
        F.transform(F.coalesce(prints_of(w, gram, span - gram + 1), F.array().cast("array<bigint>")),
                    lambda f: F.struct(f.alias("f"), F.lit(None).cast("bigint").alias("n")))))
    shown = docs.select("id", "h", F.inline(each)).join(prints, "f", "left")
    return stored(shown.filter(F.col("wanted") | F.col("n").isNotNull())
                  .select("id", "h", "f", "n"), "shared-prints")


def _occurrences(docs: DataFrame, shown: DataFrame, printed: DataFrame, span: int,
                 gram: int) -> DataFrame:
    """(id, h, item, start): where a window of ``span`` item words stands in a document."""
    reach = span - gram
    shared = shown.filter(F.col("n").isNull()).groupBy(
        F.col("id").alias("shared_id"), F.col("h").alias("shared_h")).agg(
        F.collect_set("f").alias("fs"))

    # Only those documents, with the words around each shared gram.
    def around(w: Column, g: Column, p: Column) -> Column:
        before = F.least(F.lit(reach), p - 1)
        return F.struct(F.element_at(g, p).alias("f"), p.alias("p"), before.alias("before"),
                        F.slice(w, p - before, before + span).alias("near"))

    found = docs.join(
        shared, F.col("id").eqNullSafe(F.col("shared_id")) & (F.col("h") == F.col("shared_h"))
    ).select("id", "h", F.inline(let(words(F.col("t")), lambda w: let(
        let(rough_words(F.col("t")), lambda rough: grams(rough, gram)), lambda g: F.transform(
            _positions(g, F.col("fs")), lambda p: around(w, g, p))))))
    # Each alignment of a shared gram: the gram stands ``back`` words into the window.
    aligned = found.join(lookup_side(printed), "f").withColumn(
        "back", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    mine = F.slice("near", F.col("before") - F.col("back") + 1, span)
    theirs = F.slice("iw", F.col("q") - F.col("back"), span)
    fits = (F.col("back") <= F.col("before")) & (F.col("back") < F.col("q"))
    same = F.when(fits, (mine == theirs) & (F.size(mine) == span)).otherwise(False)
    return aligned.filter(same).select(
        "id", "h", "item", (F.col("p") - F.col("back")).alias("start")).distinct()


def _search(docs: DataFrame, benchmark: DataFrame, span: int, gram: int, item_column: str,
            item_text: str) -> tuple[DataFrame, DataFrame]:
    """(id, h, item, start, span) of all occurrences; and (id, h, n_words) of every document."""
    items = stored(benchmark.select(
        F.col(item_column).alias("item"), words(text_of(item_text)).alias("iw"),
        rough_words(text_of(item_text)).alias("ir")), "items")
    length = F.least(F.size("iw"), F.lit(span))
    # At most ``span`` different lengths: windows of whole size, and whole short items.
    sizes = {row[0] for row in items.select(length.alias("n")).distinct().collect()} - {0}
    found, counted = [], None
    for size in sorted(sizes | {span}, reverse=True):
        part = gram if size == span else size
        printed = _item_prints(items.filter(length == size), size, part)
        shown = _shared_prints(docs, printed, size, part)
        if counted is None:
            counted = shown.filter(F.col("n").isNotNull()).select(
                "id", "h", F.col("n").alias("n_words"))
        found.append(_occurrences(docs, shown, printed, size, part)
                     .withColumn("span", F.lit(size)))
    return stored(reduce(DataFrame.unionByName, found), "hits"), counted


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_of(text_column)
    return docs.select(F.col(id_column).alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
                       id_column: str = "doc_id", text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row with the benchmark text found in it.

    ``n_words``, ``n_hit`` (words inside any occurrence of an item's window of
    ``span`` words), ``n_items``, ``items_sha256`` and ``contaminated``. An
    item of fewer than ``span`` words is one window. Null and empty texts have
    no words, on either side; repeated rows each get the same answer, repeated
    items count once. Empty tables give empty or clean results; other columns
    are ignored.
    """
    hits, counted = _search(_keyed(docs, id_column, text_column), benchmark, span, gram,
                            item_column, item_text)
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1))
    n_hit = hits.select("id", "h", covered.alias("p")).distinct().groupBy("id", "h").agg(
        F.count("*").alias("n_hit"))
    listed = hits.groupBy("id", "h").agg(
        F.collect_set(F.col("item").cast("string")).alias("items"))
    results = n_hit.alias("n").join(
        listed.alias("l"), F.col("n.id").eqNullSafe(F.col("l.id")) & (F.col("n.h") == F.col("l.h"))
    ).select(F.col("n.id").alias("rid"), F.col("n.h").alias("rh"), "n_hit", "items")
    joined = counted.join(results, F.col("id").eqNullSafe(F.col("rid"))
                          & (F.col("h") == F.col("rh")), "left")
    return joined.select(
        F.col("id").alias(id_column), "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")), 256)
        .alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows in which no window of a benchmark item occurs, with their own columns.

    Null, empty and repeated texts and items as in ``find_contamination``; rows
    that repeat an id with another text are judged each by its own text.
    """
    hits, _ = _search(_keyed(docs, id_column, text_column), benchmark, span, gram,
                      "item_id", "text")
    dirty_id, dirty_hash = free_names(docs, "_dirty", "_hash")
    dirty = hits.select(F.col("id").alias(dirty_id), F.col("h").alias(dirty_hash)).distinct()
    return docs.join(lookup_side(dirty), F.col(id_column).eqNullSafe(F.col(dirty_id)) & (
        F.xxhash64(text_of(text_column)) == F.col(dirty_hash)), "left_anti")

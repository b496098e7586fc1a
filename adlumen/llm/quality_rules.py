"""Quality rules: counts every corpus filter uses, and bands of compression.

zstandard says how much a text repeats itself. Prose of a given length
compresses to much the same share of its bytes; spam and boilerplate fall far
below that, keys, hashes and encoded files stay above it. The share depends
on the length (a frame costs some bytes, a longer text offers more to refer
to), so each length has its own limits. They are checked for the whole text
and for each of its fixed chunks, since a long text can hide a repetitive
part behind a normal one and the reverse.

Each row is judged by itself: nothing is shuffled, and a lost executor costs
its own partitions only.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.llm.common import text_of

LEVEL = 3
CHUNK = 4096
# Least length in bytes, least and greatest share left by the compressor. Below 100 bytes the
# frame decides. Half of what plain prose of the length takes counts as repetitive; encoded
# random bytes keep three quarters, and a frame's own bytes on top of it.
BANDS = ((0, 0.0, 9.0), (100, 0.30, 1.25), (200, 0.30, 0.95), (400, 0.28, 0.85),
         (800, 0.27, 0.78), (1600, 0.26, 0.74), (6400, 0.23, 0.70), (25600, 0.20, 0.68))
# A text goes if more than this share of its bytes lies in chunks outside their band.
BAD_SHARE = 0.2

WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"

RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "base_failed boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long, "
         "reason string, kept boolean")
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.int64(),
                             pa.string(), pa.bool_()]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window which occurs twice or more in ``words``.

    Windows are compared exactly, by ranks: two equal halves have equal ranks,
    so the window grows by joining ranks and never holds the words themselves.
    """
    if len(words) <= window:
        return 0
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    single = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    ranks, span = single, 1
    while span < window:
        step = min(span, window - span)
        # The last part may overlap the first: it ends where the longer window ends.
        ends = ranks[step:] if step == span else _grown(single, step)[span:]
        ranks = _joined(ranks[: len(ends)], ends)
        span += step
    counts = np.bincount(ranks)
    edges = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(counts[ranks] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _grown(single: np.ndarray, span: int) -> np.ndarray:
    ranks = single
    for more in range(1, span):
        ranks = _joined(ranks[:-1], single[more:])
    return ranks


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = left * (int(right.max(initial=0)) + 1) + right
    return np.unique(both, return_inverse=True)[1]


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


@functools.lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def share_left(data: bytes, level: int = LEVEL) -> float:
    """Compressed bytes per byte; 1 for nothing."""
    return len(_compressor(level).compress(data)) / len(data) if len(data) else 1.0


def outside(share: float, length: int, bands=BANDS) -> str | None:
    """``repetitive``, ``incompressible`` or None, by the limits of that length."""
    _, least, greatest = bands[bisect_right(bands, length, key=lambda band: band[0]) - 1]
    return "repetitive" if share < least else "incompressible" if share > greatest else None


def compression_verdict(data: bytes, bands=BANDS, chunk: int = CHUNK, level: int = LEVEL,
                        bad_share: float = BAD_SHARE) -> tuple[float, int, int, str | None]:
    """Share left of the whole, chunks, chunks outside their band, and why the text goes."""
    whole = share_left(data, level)
    reason = outside(whole, len(data), bands)
    if len(data) <= chunk:
        return whole, int(len(data) > 0), int(reason is not None), reason
    bad, bad_bytes, count = 0, 0, 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        count += 1
        if outside(share_left(part, level), len(part), bands):
            bad += 1
            bad_bytes += len(part)
    if reason is None and bad_bytes > bad_share * len(data):
        reason = "chunks"
    return whole, count, bad, reason


def judge(text: str, **limits) -> tuple:
    """All columns of ``RULES`` for one whole text."""
    words = _WORD.findall(text)
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    data = text.encode("utf-8", "surrogatepass")
    share, chunks, bad, reason = compression_verdict(data, **limits)
    return (len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)),
            duplicate_lines(text), repeats, failed, len(data), share, chunks, bad,
            "base" if failed else reason, not failed and reason is None)


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                bands=BANDS, chunk: int = CHUNK, level: int = LEVEL,
                bad_share: float = BAD_SHARE) -> DataFrame:
    """Every row with its counts, its compression and whether it is ``kept``.

    ``bands`` are (least length, least share, greatest share) by length and
    begin at 0. ``reason`` is ``base``, ``repetitive``, ``incompressible``,
    ``chunks`` or null. Null and empty texts have no words and fail the base
    rule. Repeated rows and ids each get their answer, an empty table gives an
    empty result, and other columns, whatever their names, are ignored. A text
    is held whole, with some sixty bytes for each of its words.
    """
    rows = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    limits = {"bands": bands, "chunk": chunk, "level": level, "bad_share": bad_share}
    names = ["_id", *(part.split()[0] for part in RULES.split(", "))]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(text.as_py(), **limits) for text in batch.column(1)]
            columns = zip(*found) if found else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, _TYPES)], names=names)

    return rows.mapInArrow(judged, f"_id {id_type}, {RULES}").withColumnRenamed("_id", id_column)

"""Language-model scores by a probabilistic suffix tree.

Tokens are words and one end per text. A text's probability is that of its words'
bytes, of the ends of its words and of its own end, each given the longest retained
context: up to ``DEPTH`` symbols before it, back over the ends of words as far as the
start of the text. Contexts enter if they make up at least ``SHARE`` of all symbols
and stay if their next symbols diverge from what the shorter context says.
Distributions are smoothed along the chain of suffixes, down to equal odds.

Counts are over all training texts: symbols with those before them are added up
within tasks and then over all. Which words of a block are known is asked by its
distinct words: (block, word) rows go to the word's partition to be counted, and
come back to the block, where its texts are scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlumen.llm.common import forget, stored, text_of

DEPTH = 6
SHARE = 2e-5  # at most 1 / SHARE contexts of each length enter
DIVERGENCE = 0.005  # bits
PRIOR = 2.0  # weight of the shorter context's distribution, in symbols
BLOCK_BYTES = 12 << 20
SLICE = 1 << 21  # symbols worked through at a time
HELD_OUT = 10

# Symbols: bytes are 1 to 256.
WORD_END, TEXT_END, START = 257, 258, 259
SYMBOLS = 258
_BITS = 9


def tokens_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased; the end token is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _sequence(text: str | bytes) -> bytes:
    """A text as its words with one space between them; bytes are taken as they are."""
    return b" ".join(tokens_of(text)) if isinstance(text, str) else text


def _laid(words: list[bytes], close: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all sequences in a row, and where each starts; spaces end words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    symbols = np.empty(sizes.sum(), np.uint16)
    inner = np.ones(len(symbols), bool)
    inner[starts] = inner[starts + sizes - 1] = False
    symbols[inner] = np.frombuffer(b"".join(words), np.uint8).astype(np.uint16) + 1
    symbols[inner & (symbols == ord(" ") + 1)] = WORD_END
    symbols[starts], symbols[starts + sizes - 1] = START, close
    return symbols, starts


def _grams(words: list[bytes], close: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each symbol but the starts, behind the ``DEPTH`` before it, and whose it is; in slices.

    What lies before a sequence is nothing, a zero.
    """
    symbols, starts = _laid(words, close)
    owner = -1
    for first in range(0, len(symbols), SLICE):
        before = max(0, first - DEPTH)
        part = symbols[before:first + SLICE].astype(np.int64)
        gram = part.copy()
        for k in range(1, DEPTH + 1):
            gram[k:] |= part[:-k] << (_BITS * k)
        near = starts[np.searchsorted(starts, before - DEPTH):np.searchsorted(starts, first + SLICE)]
        for k in range(DEPTH):
            at = near + k - before
            gram[at[(at >= 0) & (at < len(gram))]] &= (1 << (_BITS * (k + 1))) - 1
        part, gram = part[first - before:], gram[first - before:]
        owners = owner + np.cumsum(part == START)
        owner = owners[-1]
        inner = part != START
        yield gram[inner], owners[inner]


def _parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of sequences of these sizes that are laid together: a slice's symbols, one at least."""
    part = (np.cumsum(sizes + 2) - 1) // SLICE
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(sizes) else part
    return list(pairwise([*edges.tolist(), len(sizes)]))


def _turned(code: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` symbols of each code the other way round, the last one first."""
    out = np.zeros(len(code), np.int64)
    for k in range(depth):
        out |= ((code >> (_BITS * k)) & ((1 << _BITS) - 1)) << (_BITS * (depth - 1 - k))
    return out


def _shorter(code: np.ndarray, depth: int) -> np.ndarray:
    return code & ((1 << (_BITS * (depth - 1))) - 1)


def _found(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``codes`` in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return place, table[place] == codes


class SuffixTree:
    """Retained contexts by length, with their counts; an empty tree gives equal odds."""

    def __init__(self, levels: list[pd.DataFrame], prior: float = PRIOR,
                 divergence: float = DIVERGENCE):
        """``levels``: (context, next, times) for each length, context total included."""
        self.prior, self.levels = prior, []
        for depth, rows in enumerate(levels):
            codes, totals = np.unique(rows["context"].to_numpy(np.int64)), None
            place = np.searchsorted(codes, rows["context"].to_numpy(np.int64))
            times = rows["times"].to_numpy(float)
            totals = np.bincount(place, times, len(codes))
            pairs = (rows["context"].to_numpy(np.int64) << _BITS) | rows["next"].to_numpy(np.int64)
            order = np.argsort(pairs)
            if depth and len(codes):
                context = rows["context"].to_numpy(np.int64)
                before = self._chance(_shorter(context, depth), rows["next"].to_numpy(np.int64),
                                      depth - 1)
                own = times / totals[place]
                apart = np.bincount(place, own * np.log2(own / before), len(codes))
                keep = apart >= divergence
            else:
                keep = np.ones(len(codes), bool)
            self.levels.append([codes, totals, pairs[order], times[order], keep])
        # A context stays also if a longer one that ends in it does.
        for depth in range(len(self.levels) - 1, 1, -1):
            codes, keep = self.levels[depth][0], self.levels[depth][4]
            shorter = self.levels[depth - 1]
            place, there = _found(shorter[0], _shorter(codes[keep], depth))
            shorter[4][place[there]] = True
        self.levels = [self._only(*level) for level in self.levels]
        self.sorted = [self._by_last(d, *level) for d, level in enumerate(self.levels)]

    @staticmethod
    def _only(codes, totals, pairs, times, keep):
        _, there = _found(codes[keep], pairs >> _BITS)
        return codes[keep], totals[keep], pairs[there], times[there]

    @staticmethod
    def _by_last(depth, codes, totals, pairs, times):
        """The level sorted by next symbol, if any, then last symbol of the context and so on back."""
        contexts = _turned(codes, depth)
        both = (pairs & ((1 << _BITS) - 1)) << (_BITS * depth) | _turned(pairs >> _BITS, depth)
        first, second = np.argsort(contexts), np.argsort(both)
        return contexts[first], totals[first], both[second], times[second]

    def _chance(self, context: np.ndarray, nexts: np.ndarray, depth: int) -> np.ndarray:
        """Probability of each next symbol, smoothed along the suffixes of its context."""
        chance = np.full(len(context), 1 / SYMBOLS)
        for d in range(depth + 1):
            if d >= len(self.levels):
                break
            code = context & ((1 << (_BITS * d)) - 1)
            chance = self._mixed(d, code, nexts, chance)
        return chance

    def _mixed(self, depth: int, code: np.ndarray, nexts: np.ndarray,
               chance: np.ndarray) -> np.ndarray:
        codes, totals, pairs, times = self.levels[depth][:4]
        place, there = _found(codes, code)
        if not there.any():
            return chance
        at, seen = _found(pairs, (code[there] << _BITS) | nexts[there])
        count = np.where(seen, times[at] if len(times) else 0.0, 0.0)
        mixed = chance.copy()
        mixed[there] = (count + self.prior * chance[there]) / (totals[place[there]] + self.prior)
        return mixed

    def _of_grams(self, grams: np.ndarray) -> np.ndarray:
        """Probability of each distinct gram's last symbol, grams that end alike taken as one.

        Turned round and sorted, those stand together, and so does what they are looked up in.
        """
        turned = (grams & ((1 << _BITS) - 1)) << (_BITS * DEPTH) | _turned(grams >> _BITS, DEPTH)
        order = np.argsort(turned)
        turned = turned[order]
        chance = np.full(len(grams), 1 / SYMBOLS)
        # Only a context whose suffix is in the tree can be there itself.
        left = np.arange(len(grams))
        for d, (contexts, totals, pairs, times) in enumerate(self.sorted):
            ending = turned[left] >> (_BITS * (DEPTH - d))
            first = np.flatnonzero(np.r_[True, ending[1:] != ending[:-1]])
            alike = np.diff(np.r_[first, len(left)])
            pair = ending[first]
            place, there = _found(contexts, pair & ((1 << (_BITS * d)) - 1))
            if not there.any():
                break
            at, seen = _found(pairs, pair[there])
            count = np.where(seen, times[at], 0.0)
            mixed = (count + self.prior * chance[left[first[there]]]) / (
                totals[place[there]] + self.prior)
            left = left[np.repeat(there, alike)]
            chance[left] = np.repeat(mixed, alike[there])
        out = np.empty(len(grams))
        out[order] = chance
        return out

    def log10_words(self, words: list[bytes], close: int = WORD_END) -> np.ndarray:
        """log10 probability of each sequence, its end included."""
        out = np.zeros(len(words))
        for gram, owner in _grams(words, close):
            own, place = np.unique(gram, return_inverse=True)
            chance = self._of_grams(own)
            out += np.bincount(owner, np.log10(chance)[place], len(words))
        return out


def _counted(close: int):
    """Grams of sequences (word, times) with how often they occur, added up within the task."""
    def pieces(held: list) -> tuple[np.ndarray, np.ndarray]:
        grams, times = (np.concatenate(kind) for kind in zip(*held))
        held.clear()
        order = np.argsort(grams, kind="stable")  # merges what is sorted already
        grams, times = grams[order], times[order]
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        return grams[first], np.add.reduceat(times, first)

    def written(grams: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(grams), 200_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at:at + 200_000]), pa.array(times[at:at + 200_000])],
                names=["gram", "times"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for at, end in _parts(pc.binary_length(batch.column(0)).to_numpy()):
                words = [_sequence(w) for w in batch.column(0).slice(at, end - at).to_pylist()]
                weight = weights[at:end]
                for gram, owner in _grams(words, close):
                    if (weight == 1).all():
                        held.append(np.unique(gram, return_counts=True))
                    else:
                        own, place = np.unique(gram, return_inverse=True)
                        held.append((own, np.bincount(place, weight[owner], len(own)).astype(
                            np.int64)))
                    if sum(len(g) for g, _ in held) > 2 * SLICE:
                        held = [pieces(held)]
                        if len(held[0][0]) > SLICE:
                            yield from written(*held.pop())
        if held:
            yield from written(*pieces(held))
        pa.default_memory_pool().release_unused()

    return counted


def _level(grams: DataFrame, depth: int, ends: int, least: float) -> pd.DataFrame:
    """Contexts of one length with their next symbols, those seen ``least`` times.

    There are at most total / least of them. The suffix of a context is seen no
    less often, so it comes back as well.
    """
    code = F.shiftright("gram", _BITS).bitwiseAND((1 << (_BITS * depth)) - 1)
    rows = grams.select(code.alias("context"), F.col("gram").bitwiseAND((1 << _BITS) - 1).alias("next"),
                        "times")
    if depth:
        rows = rows.filter(F.shiftright("context", _BITS * (depth - 1)) > 0)
    if ends and depth < 2:  # the end of a text stands where a word could start
        rows = rows.unionByName(grams.sparkSession.createDataFrame(
            [(START if depth else 0, TEXT_END, ends)], rows.schema))
    summed = rows.groupBy("context", "next").agg(F.sum("times").alias("times"))
    found = summed.groupBy("context").agg(
        F.sum("times").alias("total"), F.collect_list(F.struct("next", "times")).alias("nexts")
    ).filter(F.col("total") >= least).select("context", F.inline("nexts"))
    return found.toPandas()


def train(words: DataFrame, ends: int = 0, depth: int = DEPTH, share: float = SHARE,
          close: int = WORD_END) -> SuffixTree:
    """Tree over sequences (``word``, ``times``): whole texts that ``close`` with their end.

    Bare words are sequences as well; ``ends`` is then how many texts they came from.
    """
    grams = stored(words.select("word", "times").mapInArrow(
        _counted(close), "gram bigint, times bigint").groupBy("gram").agg(
            F.sum("times").alias("times")), "grams")
    levels = [_level(grams, 0, ends, 0)]
    total = int(levels[0]["times"].sum())
    for d in range(1, depth + 1):
        levels.append(_level(grams, d, ends, max(2, share * total)))
        if not len(levels[-1]):
            break
    forget(grams)
    return SuffixTree(levels)


def held_out(id_column: str = "doc_id"):
    part = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(HELD_OUT)) == 0
    return F.coalesce(part, F.lit(False))


def score_documents(docs: DataFrame, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Every row with its unigram ``base_score`` and the suffix tree's ``score``.

    ``n_tokens`` counts words and the end, ``n_known`` those seen in training,
    ``train_tokens`` all of training. Null texts are empty: one end token.
    Rows with a null id train. Repeated rows each count and each get the
    answer. An empty table gives an empty result; other columns are ignored.
    """
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("t"),
                       held_out(id_column).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("t").cast("bigint")), F.count("*"),
                    F.count_if(~F.col("held_out"))).first()
    blocks, ends = max(1, -(-(size[0] or 0) // BLOCK_BYTES)), size[2]
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)).cast("int"))
    id_type = rows.schema["id"].dataType.simpleString()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of each block within the task, with their training count."""
        seen: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), block, np.int32)),
                     pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())],
                    names=["block", "word", "n"])
            seen.clear()

        for batch in batches:
            for block, text, out in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = seen.setdefault(block, Counter())
                found = Counter(tokens_of(text))
                words.update(dict.fromkeys(found, 0) if out else found)
                if out:
                    for word in found:
                        words.setdefault(word, 0)
            if sum(map(len, seen.values())) > 1_000_000:
                yield from flush()
        yield from flush()

    # Laid out by block first, so that a task has few blocks and a word is asked for once in each.
    laid = rows.select("block", "t", "held_out").repartition("block")
    requests = laid.mapInArrow(asked, "block int, word binary, n bigint")
    word = Window.partitionBy("word")
    known = stored(
        requests.withColumn("times", F.sum("n").over(word)).withColumn(
            "first", F.row_number().over(word.orderBy("block")) == 1).drop("n"), "words")
    train_words = known.filter("first and times > 0")
    total, distinct = train_words.agg(F.sum("times"), F.count("*")).first()
    total = (total or 0) + ends
    distinct += ends > 0
    texts = rows.filter(~F.col("held_out")).select(F.col("t").alias("word"),
                                                   F.lit(1).cast("bigint").alias("times"))
    tree = known.sparkSession.sparkContext.broadcast(train(texts, close=TEXT_END))
    answers = known.select("block", "word", "times")
    floor = 0.1 * (distinct + 1) + total

    def of_block(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        place = {w: i for i, w in enumerate(words["word"])}
        times = words["times"].to_numpy(np.int64)
        base = np.log10((times + 0.1) / floor)
        out = []
        for first, end in _parts(texts["t"].str.len().to_numpy(np.int64)):
            found = [tokens_of(text) for text in texts["t"].iloc[first:end]]
            score = tree.value.log10_words([b" ".join(words) for words in found], TEXT_END)
            for words, logp in zip(found, score):
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                out.append((len(words) + 1, int((times[at] > 0).sum()) + (ends > 0),
                            base[at].sum() + np.log10((ends + 0.1) / floor), logp))
        result = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        return pd.concat([texts[["id", "held_out"]].reset_index(drop=True), result], axis=1)

    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        of_block, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, "
                  "base_score double, score double")
    return found.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known",
                        F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")

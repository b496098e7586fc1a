"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols start as characters. An agenda holds every adjacent pair that
is a piece, best score first and leftmost among equals; the best is merged and
its new neighbours join the agenda, until none is left. What is no piece falls
back to bytes. Where no piece of the vocabulary crosses from one kind of
character to another (before word marks, between letters and punctuation), a
text is cut and its parts are merged by themselves, many parts side by side, and results met
lately are kept.
The vocabulary comes from the model file; each batch is checked against the
library: every newly merged part, and every decoded text.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.llm.common import text_of

MARK = "▁"  # stands for a space inside pieces
# Merged parts a Python worker gathers before it lets go of those not met since it last did;
# most occur in one text only, and some 250 bytes are held for each of twice as many.
KEPT_PARTS = 200_000
LISTED = 48  # up to so many characters a list is faster than a heap
MANY, ROWS = 256, 4096  # from so many parts on they are merged side by side, so many at a time
_NONE = np.iinfo(np.int32).max  # rank of a pair that is no piece
_LETTER, _SIGN = r"[^\W_]", r"[\x00-\x2f:-@\[-`{-\x7f]"
_CROSSING = re.compile(f"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}")
_FINE = re.compile(f"{MARK}*{_LETTER}++(?={MARK}|{_SIGN}|$)|{MARK}*{_SIGN}++(?={MARK}|{_LETTER}|$)"
                   f"|{MARK}*[^{MARK}]+|{MARK}+")
_COARSE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PLACE = (1 << 32) - 1
# A model that changes none of this only puts marks for spaces and one before the text.
PROBE = "  A\u00e9 e\u0301\t\uff21 \ufb01\u00a0\u3000\u200b\r\n\u2460 x\x00  "


class PieceModel:
    """Vocabulary and merge order of one model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.vocab_size())
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in ids]
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not merge-only")
        self.unknown = lib.unk_id()
        self.ids = {lib.id_to_piece(i): i for i in ids if not special[i]}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        scores = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {score: rank for rank, score in enumerate(scores)}
        # Pieces of equal score share a rank; then the leftmost pair goes first.
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids):
            self.parts = None
        else:
            self.parts = _COARSE if any(map(_CROSSING.search, self.ids)) else _FINE
        self._pair_table()
        self.raw = {i: b"" if lib.is_control(i) else lib.id_to_piece(i).encode() for i in ids}
        self.raw |= {i: bytes([value]) for value, i in self.bytes.items()}
        self.plain = lib.normalize(PROBE) == self._marked(PROBE)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair_table(self) -> None:
        """Pairs of pieces that make a piece, as sorted numbers; pieces are numbered as listed."""
        number = {piece: k for k, piece in enumerate(self.ids)}
        self.listed = np.array(list(self.ids.values()), np.int32)
        # The piece of each character; others follow, unless they are only known inside a piece.
        self.single = np.arange(0x110000, dtype=np.int32) + len(number)
        for char in {char for piece in number for char in piece}:
            self.single[ord(char)] = number.get(char, -1)
        self.step = len(number) + 0x110001  # so that no pair with -1 has the number of another
        pairs = sorted((number[p[:k]] * self.step + number[p[k:]], rank, number[p])
                       for p, rank in self.rank.items() for k in range(1, len(p))
                       if p[:k] in number and p[k:] in number)
        table = np.array(pairs or [(-1, _NONE, 0)], np.int64)
        self.pairs, self.pair_rank = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self.pair_piece = table[:, 2].astype(np.int32)

    @staticmethod
    def _marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def split(self, text: str) -> list[str]:
        """Parts of the normalised text that merge independently."""
        plain = self._marked(text) if self.plain else self.library.normalize(text)
        return self.parts.findall(plain) if self.parts else [plain] if plain else []

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda; short parts keep it as a list, long ones as a heap."""
        symbols = list(part)
        (self._merge_listed if len(symbols) <= LISTED else self._merge_heaped)(symbols)
        found: list[int] = []
        for symbol in filter(None, symbols):
            known = self.ids.get(symbol)
            if known is not None:
                found.append(known)
            else:
                found.extend(self._fallen(symbol))
        return found

    def _merge_listed(self, symbols: list[str]) -> None:
        """Merges in place; ``agenda`` has the rank of each symbol with its right neighbour."""
        rank, none = self.rank.get, len(self.ids)
        agenda = [rank(a + b, none) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            both = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + both, none)

    def _merge_heaped(self, symbols: list[str]) -> None:
        """Merges in place and leaves empty strings for what went into a neighbour."""
        end, rank = len(symbols), self.rank.get
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        agenda = [r << 32 | i for i in range(end - 1)
                  if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            left = best & _PLACE
            right = after[left]
            if right >= end or not symbols[left]:
                continue
            both = symbols[left] + symbols[right]
            if rank(both) != best >> 32:  # one of the two has merged since
                continue
            symbols[left], symbols[right] = both, ""
            beyond = after[left] = after[right]
            if beyond < end:
                before[beyond] = left
                if (r := rank(both + symbols[beyond])) is not None:
                    heappush(agenda, r << 32 | left)
            ahead = before[left]
            if ahead >= 0 and (r := rank(symbols[ahead] + both)) is not None:
                heappush(agenda, r << 32 | ahead)

    def merge_many(self, parts: list[str]) -> list[bytes]:
        """Ids of each part as ``merge`` gives them, packed; those of like lengths go together."""
        merged: list[bytes | None] = [None] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        flat = self.single[np.frombuffer(
            "".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        plain = np.flatnonzero((sizes <= LISTED) & (np.minimum.reduceat(flat, starts) >= 0))
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        for at in range(0, len(plain), ROWS):
            rows = plain[at:at + ROWS]
            column = np.arange(sizes[rows[-1]])
            place = np.minimum(starts[rows, None] + column, len(flat) - 1)
            ids, counts = self._merge_rows(np.where(column < sizes[rows, None], flat[place], -1))
            data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            for row, a, b in zip(rows.tolist(), [0, *ends], ends):
                merged[row] = data[a:b]
        return [array("i", self.merge(part)).tobytes() if ids is None else ids
                for part, ids in zip(parts, merged)]

    def _made(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that two make, for many; _NONE where there is none."""
        pair = left.astype(np.int64) * self.step + right
        where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return (np.where(self.pairs[where] == pair, self.pair_rank[where], _NONE),
                self.pair_piece[where])

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that the pieces of each row merge to, end to end, and how many each row has.

        ``rows`` holds numbers of pieces, -1 after a row's end. The agenda has the rank of
        each symbol with its right neighbour; each turn merges the best of every row.
        """
        count, width = rows.shape[0], rows.shape[1] + 1
        symbols = np.concatenate([rows, np.full((count, 1), -1)], axis=1).astype(np.int32).ravel()
        after = np.arange(1, len(symbols) + 1)
        before = np.arange(-1, len(symbols) - 1)
        before[::width] += width  # what stands before a row is the -1 at its end
        ranks, into = self._made(symbols, np.r_[symbols[1:], np.int32(-1)])
        agenda, live = ranks.reshape(count, width), np.arange(count)
        while len(live):
            now = agenda[live]
            column = now.argmin(axis=1)
            more = now[np.arange(len(live)), column] < _NONE
            live = live[more]
            i = live * width + column[more]
            gone = after[i]
            beyond, ahead = after[gone], before[i]
            symbols[i], symbols[gone], ranks[gone] = into[i], -1, _NONE
            after[i], before[beyond] = beyond, i
            left = np.concatenate([i, ahead])
            ranks[left], into[left] = self._made(
                symbols[left], symbols[np.concatenate([beyond, i])])
        there = np.flatnonzero(symbols >= 0)
        found = symbols[there]
        others = np.flatnonzero(found >= len(self.listed))
        if not len(others):
            return self.listed[found], np.bincount(there // width, minlength=count)
        chars, which = np.unique(found[others] - len(self.listed), return_inverse=True)
        known = [self._fallen(chr(char)) for char in chars.tolist()]
        sizes = np.ones(len(found), np.int64)
        sizes[others] = np.array([len(ids) for ids in known])[which]
        found[others] = 0
        ids = np.repeat(self.listed[found], sizes)
        ids[np.repeat(np.isin(np.arange(len(found)), others), sizes)] = np.concatenate(
            [known[k] for k in which.tolist()])
        return ids, np.bincount(there // width, sizes, count).astype(np.int64)

    def _fallen(self, symbol: str) -> list[int]:
        """Ids of what is no piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def _asked(self, parts: list[str]) -> list[list[int]]:
        """What the library says of each part, behind a character it cannot merge with."""
        letter = re.compile(_LETTER).match
        before = ["" if p[0] == MARK else "," if letter(p) else "a" for p in parts]
        known = {x: len(self.library.encode(x)) for x in ("", "a", ",")}
        asked = [x + p[x == "":] for x, p in zip(before, parts)]
        found = self.library.encode(asked, num_threads=1) if asked else []
        return [ids[known[x]:] for x, ids in zip(before, found)]

    def encode_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the library gave the same for its new parts.

        A text with a part on which the library differs takes the library's ids.
        """
        if len(self.kept) > KEPT_PARTS:
            self.kept, self.older = {}, self.kept
        parts = [self.split(text) for text in texts]
        met = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.kept]
        self.kept.update((p, self.older[p]) for p in met if p in self.older)
        new = [p for p in met if p not in self.kept]
        merged = (self.merge_many(new) if len(new) >= MANY
                  else [array("i", self.merge(p)).tobytes() for p in new])
        wrong = {p for p, ids, theirs in zip(new, merged, self._asked(new))
                 if ids != array("i", theirs).tobytes()}
        self.kept.update(zip(new, merged))
        encoded, agrees = [], []
        for text, own_parts in zip(texts, parts):
            sure = not wrong or wrong.isdisjoint(own_parts)
            agrees.append(sure)
            encoded.append(np.frombuffer(b"".join(map(self.kept.__getitem__, own_parts)), np.int32)
                           if sure else np.array(self.library.encode(text), np.int32))
        for part in wrong:
            del self.kept[part]
        return encoded, agrees

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the one put before the text goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text.replace(MARK, " ").removeprefix(" ")


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


CODED = "ids array<int>, decoded string, agrees boolean"


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """Every row with the ``ids`` of its whole text and the text ``decoded`` from them.

    ``agrees`` tells that the library gave the same ids for the words merged
    first in this batch and decoded the same text; a row where it does not
    has the library's result. Null texts are empty: no ids, empty decoded
    text. Repeated rows each get the answer; other columns are ignored.
    ``model`` is a path every executor can read.
    """
    rows = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            # A few documents at a time, so that a batch of long texts stays small.
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                encoded, agrees = pieces.encode_batch(some.column(1).to_pylist())
                lists = [ids.tolist() for ids in encoded]
                theirs = pieces.library.decode(lists, num_threads=1)
                mine = map(pieces.decode, lists)
                same = [ok and a == b for ok, a, b in zip(agrees, mine, theirs)]
                ends = np.cumsum([0, *map(len, encoded)])
                flat = np.concatenate([np.zeros(0, np.int32), *encoded])
                yield pa.RecordBatch.from_arrays([
                    some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                    pa.array(theirs, pa.string()), pa.array(same),
                ], names=["_id", "ids", "decoded", "agrees"])
            # Gone before the next batch comes, so that a worker never holds two.
            del batch, some, encoded, lists, theirs, mine, flat
            pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(coded, f"_id {id_type}, {CODED}")
    return out.withColumnRenamed("_id", id_column)


def digests(coded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Count and digests of what ``encode_documents`` returns."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        id_column, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )

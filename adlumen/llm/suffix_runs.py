"""Sorted runs of byte strings, front-coded for exchange, merged without comparing twice.

Each entry of a run holds how many bytes it shares with the one before and the
rest. Runs are combined by a loser tree that knows, for every waiting string, its
common prefix with the last one put out: if these differ for two strings they
decide, and otherwise comparison starts behind them.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import Struct

_ENTRY = Struct("<HHq")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[known:size]) ^ int.from_bytes(b[known:size])
    return size - (differ.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, int]]) -> bytes:
    """A run of sorted (key, id)."""
    out, last = [], b""
    for key, ident in entries:
        shared = common(last, key)
        out += [_ENTRY.pack(shared, len(key) - shared, ident), key[shared:]]
        last = key
    return b"".join(out)


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(key, id, bytes shared with the key before) of a run."""
    at, last = 0, b""
    while at < len(blob):
        shared, rest, ident = _ENTRY.unpack_from(blob, at)
        at += _ENTRY.size
        last = last[:shared] + blob[at:at + rest]
        at += rest
        yield last, ident, shared


class LoserTree:
    """Merges runs; iterating gives (key, id, bytes shared with the key given before)."""

    def __init__(self, blobs: list[bytes]):
        self.runs = [read_run(blob) for blob in blobs]
        self.heads: list[tuple | None] = [None] * len(blobs)
        self.shared = [0] * len(blobs)
        self.width = 1
        while self.width < len(blobs):
            self.width *= 2
        self.losers: list[int | None] = [None] * self.width

    def _advance(self, run: int) -> None:
        self.heads[run] = head = next(self.runs[run], None)
        # The key before it in its run is the last one put out.
        self.shared[run] = head[2] if head else 0

    def _first(self, one: int | None, other: int | None) -> tuple[int | None, int | None]:
        """Winner and loser; the loser learns its common prefix with the winner."""
        if one is None or self.heads[one] is None:
            return other, one
        if other is None or self.heads[other] is None:
            return one, other
        p, q = self.shared[one], self.shared[other]
        if p != q:
            return (one, other) if p > q else (other, one)
        a, b = self.heads[one][0], self.heads[other][0]
        known = common(a, b, p)
        winner, loser = (one, other) if a[known:known + 1] <= b[known:known + 1] else (other, one)
        self.shared[loser] = known
        return winner, loser

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        if not self.runs:
            return
        for run in range(len(self.runs)):
            self._advance(run)
        level: list[int | None] = [*range(len(self.runs)),
                                   *[None] * (self.width - len(self.runs))]
        base = self.width
        while base > 1:
            base //= 2
            winners = []
            for k in range(base):
                winner, self.losers[base + k] = self._first(level[2 * k], level[2 * k + 1])
                winners.append(winner)
            level = winners
        top = level[0]
        while top is not None and self.heads[top] is not None:
            yield self.heads[top][0], self.heads[top][1], self.shared[top]
            self._advance(top)
            node = (self.width + top) // 2
            while node:
                top, self.losers[node] = self._first(top, self.losers[node])
                node //= 2

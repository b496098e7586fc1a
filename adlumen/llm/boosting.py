"""Gradient-boosted trees for two classes, small enough to send to every task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees of fixed depth stored as arrays: feature and cut per inner node, value per leaf."""

    depth: int = 3
    rate: float = 0.2
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - (2 ** self.depth - 1)]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> Boosted:
        cuts = cuts_of(np.quantile(x, LEVELS, axis=0).T)
        own = Examples(in_bins(x, cuts), y, np.ones(len(y)))
        found = self.fit_sums(len(cuts), y.mean(), own.sums, rounds, ridge).of_values(cuts)
        self.start, self.trees = found.start, found.trees
        return self

    def fit_sums(self, features: int, mean: float, sums: Callable, rounds: int = 60,
                 ridge: float = 1.0) -> Boosted:
        """Trees over bins instead of values, from sums over all examples.

        ``sums(trees, tree, level)`` is what ``Examples.sums`` gives, added up over
        however many parts the examples lie in. A cut is the last bin of the left.
        """
        mean = np.clip(mean, 1e-3, 1 - 1e-3)
        own = Boosted(self.depth, self.rate, float(np.log(mean / (1 - mean))))
        for _ in range(rounds):
            own.trees.append(own._tree(features, sums, ridge))
        return own

    def of_values(self, cuts: list[np.ndarray]) -> Boosted:
        """The trees of ``fit_sums`` over the values themselves."""
        def value(feature: int, place: int) -> float:
            return float(cuts[feature][place]) if place < BINS else np.inf

        return Boosted(self.depth, self.rate, self.start, [
            (feature, np.array([value(f, p) for f, p in zip(feature, place)]), leaf)
            for feature, place, leaf in self.trees])

    def _tree(self, features: int, sums: Callable, ridge: float):
        inner = 2 ** self.depth - 1
        feature, place = np.zeros(inner, np.int64), np.full(inner, BINS)
        for level in range(self.depth):
            first, width = 2 ** level - 1, 2 ** level
            g, h = sums(self, (feature, place), level).cumsum(-1)
            best = np.zeros(width)
            ends = np.stack([g[:, 0, -1], h[:, 0, -1]])  # nothing goes right unless a cut is found
            for k in range(features):
                left, total = g[:, k, :-1], g[:, k, -1:]
                gain = (left ** 2 / (h[:, k, :-1] + ridge) + (total - left) ** 2 / (
                    h[:, k, -1:] - h[:, k, :-1] + ridge) - total ** 2 / (h[:, k, -1:] + ridge))
                top = gain.argmax(1)
                found = gain[np.arange(width), top]
                better = np.flatnonzero(found > best + 1e-9)
                best[better] = found[better]
                feature[first + better], place[first + better] = k, top[better]
                ends[:, better] = g[better, k, top[better]], h[better, k, top[better]]
        every = np.stack([g[:, 0, -1], h[:, 0, -1]])
        g, h = np.stack([ends, every - ends], 2).reshape(2, -1)
        return feature, place, -self.rate * g / (h + ridge)


LEVELS = np.linspace(0, 1, BINS)[1:-1]


def cuts_of(quantiles: np.ndarray) -> list[np.ndarray]:
    """The cuts of each feature from its quantiles at ``LEVELS``."""
    return [np.unique(q) for q in quantiles]


def in_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value: a value is above a cut if its bin is above its place."""
    return np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T)], 1).astype(np.uint8)


class Examples:
    """Examples in bins, each so many times, and what a tree's next level needs of them."""

    def __init__(self, bins: np.ndarray, right: np.ndarray, times: np.ndarray):
        self.bins, self.right, self.times = bins, right, times
        self._raw, self._done = np.zeros(len(bins)), 0

    def raw(self, trees: Boosted) -> np.ndarray:
        """Log odds under ``trees``; those of earlier calls are not gone through again."""
        fresh = Boosted(trees.depth, trees.rate, 0.0 if self._done else trees.start,
                        trees.trees[self._done:])
        if fresh.trees or not self._done:
            self._raw = self._raw * bool(self._done) + fresh.raw(self.bins)
            self._done = len(trees.trees)
        return self._raw

    def sums(self, trees: Boosted, tree: tuple, level: int) -> np.ndarray:
        """Gradient and curvature by node of the level, feature and bin."""
        feature, place = tree
        chance = 1 / (1 + np.exp(-self.raw(trees)))
        node = np.zeros(len(self.bins), np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (self.bins[np.arange(len(node)), feature[node]] > place[node])
        first, width, features = 2 ** level - 1, 2 ** level, self.bins.shape[1]
        slots = (node - first) * BINS
        return np.stack([
            np.stack([np.bincount(slots + column, weight, width * BINS).reshape(width, BINS)
                      for column in self.bins.T], 1)
            for weight in ((chance - self.right) * self.times,
                           (chance * (1 - chance) + 1e-6) * self.times)
        ]).reshape(2, width, features, BINS)


def lowest_sure(chance: np.ndarray, right: np.ndarray, precision: float,
                otherwise: float = 0.99, times: np.ndarray | None = None) -> float:
    """A threshold whose picks are right at least ``precision`` of the time.

    Each chance stands for ``times`` examples (one), ``right`` of which are. It lies halfway between the last example that may be picked and the next one below.
    """
    if not len(chance) or not right.any():
        return otherwise
    order = np.argsort(-chance, kind="stable")
    of = np.arange(1, len(order) + 1) if times is None else np.cumsum(times[order])
    last = np.r_[chance[order][1:] != chance[order][:-1], True]
    good = np.flatnonzero((np.cumsum(right[order]) / of >= precision) & last)
    if not len(good):
        return otherwise
    ordered = np.r_[chance[order], 0.0]
    return float(ordered[good[-1]] + ordered[good[-1] + 1]) / 2

"""A cover tree over integer vectors, searched by inner product.

Each vector gets one more coordinate that brings all of them to one norm
(the greatest of the block), so that a large inner product with a query is a
small distance to it. A node stands for a ball around one of its rows; the
balls of a level have half the radius of the level above. For a query q at
distance d from a centre c, every row x under a node of radius r has
``d - r <= |q - x| <= d + r``, and besides ``|q.x - q.c| <= |q| r``: both bound
its inner product.

Rows are kept in the order of the tree, so a node is a range of rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Nodes of this many rows are not split further.
LEAF = 24
# Rows verified at a time.
CHUNK = 512
# Inner products beyond this are not exact in double precision.
EXACT = 2.0 ** 53
LONG = (1 << 63) - 1


class CoverTree(NamedTuple):
    ids: np.ndarray  # int64
    vectors: np.ndarray  # rows by components, whole numbers as float64
    center: np.ndarray  # row of each node's centre
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray  # -1 for the root; parents come before their children
    radius: np.ndarray
    leaf: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """The tree of one block of rows (quadratic in their number, so blocks are small)."""
    squares = (vectors * vectors).sum(axis=1)
    # Augmented distances: the norms' part cancels, M2 - |x|2 is the square of the new coordinate.
    extra = np.sqrt(np.maximum(squares.max() - squares, 0))
    full = np.column_stack([vectors, extra])
    norm = squares.max()
    apart = np.sqrt(np.maximum(2 * norm - 2 * (full @ full.T), 0))
    # Rounding must never shrink a ball.
    slack = 1e-6 * np.sqrt(norm) + 1e-9
    order: list[int] = []
    nodes: list[tuple] = []  # centre, start, end, parent, radius, leaf

    # An explicit stack: depth may pass what recursion allows.
    stack = [(np.argsort(ids, kind="stable"), -1)]
    while stack:
        rows, parent = stack.pop()
        center = rows[0]
        reach = apart[center, rows].max() + slack
        small = len(rows) <= leaf or reach <= 2 * slack
        number = len(nodes)
        # Children are put on the stack together and so follow each other in the order.
        nodes.append((center, len(order), len(order) + len(rows), parent, reach, small))
        if small:
            order.extend(rows.tolist())
            continue
        children = []
        left = rows
        while len(left):
            near = apart[left[0], left] <= reach / 2
            near[0] = True
            children.append(left[near])
            left = left[~near]
        stack.extend((child, number) for child in reversed(children))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    center, start, end, parents, radius, leaves = zip(*nodes)
    return CoverTree(ids[order], vectors[order], place[np.array(center)], np.array(start),
                     np.array(end), np.array(parents), np.array(radius), np.array(leaves))


class Best:
    """The first ``k`` rows of each of many searches, by score, then by smaller id.

    Search ``w`` belongs to query ``of[w]`` and wants scores from ``low[w]`` to ``high[w]``.
    """

    def __init__(self, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.of, self.low, self.high, self.k = of, low, high, k
        self.search = np.zeros(0, np.int64)
        self.score = np.zeros(0, low.dtype)
        self.id = np.zeros(0, np.int64)
        # The least score that could still enter.
        self.least = self.low.copy()

    def offer(self, searches: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows by scores (one line per search); ``ids`` are those of the columns."""
        line, column = np.nonzero((scores >= self.least[searches][:, None])
                                  & (scores <= self.high[searches][:, None]))
        if not len(line):
            return
        search = np.concatenate([self.search, searches[line]])
        score = np.concatenate([self.score, scores[line, column].astype(self.score.dtype)])
        row = np.concatenate([self.id, ids[line, column] if ids.ndim == 2 else ids[column]])
        order = np.lexsort((row, -score, search))
        search, score, row = search[order], score[order], row[order]
        first = np.searchsorted(search, search)
        place = np.arange(len(search)) - first
        keep = place < self.k
        self.search, self.score, self.id = search[keep], score[keep], row[keep]
        last = place == self.k - 1
        self.least[search[last]] = score[last]


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in Python's integers where doubles would round."""
    bound = np.sqrt((queries * queries).sum(axis=1).max(initial=0)
                    * (rows * rows).sum(axis=1).max(initial=0))
    if bound < EXACT:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(rows).T, -LONG, LONG)


def search(tree: CoverTree, queries: np.ndarray, query_ids: np.ndarray, best: Best,
           others_only: bool) -> int:
    """Offer ``best`` what the tree holds for the queries; returns the rows verified.

    Level by level, nodes whose ball lies outside every search's window, or
    below its least score, are left out; leaves are verified in full, those
    with the highest bound first, which raises the least scores for the rest.
    """
    width = min(tree.vectors.shape[1], queries.shape[1])
    vectors, asked = tree.vectors[:, :width], queries[:, :width]
    norms = np.sqrt((queries * queries).sum(axis=1))
    greatest = (tree.vectors * tree.vectors).sum(axis=1).max()
    children = np.argsort(tree.parent, kind="stable")
    first = np.searchsorted(tree.parent[children], np.arange(len(tree.parent) + 1))
    verified = 0
    level = np.array([0])
    while len(level):
        highest, lowest = _bounds(tree, level, vectors, asked, norms, greatest)
        inner: list[np.ndarray] = []
        rank = np.argsort(-highest.max(axis=0), kind="stable")
        pending: list[int] = []
        rows_pending = 0
        for at in rank.tolist():
            # Single rows need no bound of their own: they are verified as they are.
            node = level[at]
            pending.append(at)
            rows_pending += int(tree.end[node] - tree.start[node]) if tree.leaf[node] else 1
            if rows_pending >= CHUNK:
                verified += _visit(tree, level, pending, highest, lowest, vectors, asked,
                                   query_ids, best, others_only, inner)
                pending, rows_pending = [], 0
        if pending:
            verified += _visit(tree, level, pending, highest, lowest, vectors, asked, query_ids,
                               best, others_only, inner)
        below = [children[first[n]:first[n + 1]] for n in inner]
        level = np.concatenate(below) if below else np.zeros(0, np.int64)
    return verified


def _bounds(tree: CoverTree, nodes: np.ndarray, vectors: np.ndarray, asked: np.ndarray,
            norms: np.ndarray, greatest: float) -> tuple[np.ndarray, np.ndarray]:
    """Highest and lowest inner product under each node (columns) for each query (lines)."""
    middle = (asked @ vectors[tree.center[nodes]].T).astype(float)
    radius = tree.radius[nodes]
    total = norms[:, None] ** 2 + greatest
    apart = np.sqrt(np.maximum(total - 2 * middle, 0))
    nearest = np.maximum(apart - radius, 0)
    reach = norms[:, None] * radius
    slack = 1e-6 * (total + np.abs(middle)) + 1
    highest = np.minimum((total - nearest ** 2) / 2, middle + reach) + slack
    lowest = np.maximum((total - (apart + radius) ** 2) / 2, middle - reach) - slack
    return highest, lowest


def _visit(tree: CoverTree, level: np.ndarray, places: list[int], highest: np.ndarray,
           lowest: np.ndarray, vectors: np.ndarray, asked: np.ndarray, query_ids: np.ndarray,
           best: Best, others_only: bool, inner: list[int]) -> int:
    """Verify the leaves among some nodes of a level; note the others that are still wanted."""
    at = np.array(places)
    wanted = (highest[:, at][best.of] >= best.least[:, None]) & (
        lowest[:, at][best.of] <= best.high[:, None])
    alive = wanted.any(axis=0)
    nodes = level[at[alive]]
    inner.extend(nodes[~tree.leaf[nodes]].tolist())
    leaves = nodes[tree.leaf[nodes]]
    if not len(leaves):
        return 0
    rows = np.concatenate([np.arange(tree.start[n], tree.end[n]) for n in leaves])
    searches = np.flatnonzero(wanted[:, alive][:, tree.leaf[nodes]].any(axis=1))
    used, line = np.unique(best.of[searches], return_inverse=True)
    for begin in range(0, len(rows), CHUNK):
        some = rows[begin : begin + CHUNK]
        scores = exact_scores(asked[used], vectors[some])
        ids = tree.ids[some]
        if others_only:
            own = query_ids[used][:, None] == ids[None, :]
            scores = np.where(own, -np.inf if scores.dtype == float else -1 << 100, scores)
        best.offer(searches, scores[line], ids)
    return len(rows)

"""Gradient-boosted trees for two classes as flat NumPy node arrays, with monotonic constraints.

Trees are grown level by level on binned features: gradient sums per (node, bin) come from one
bincount per feature and level. A split on a constrained feature is taken only if its two leaf values
stand in the wanted order, and the middle of the two bounds everything grown below it later, so the
whole ensemble is monotonic in that feature. All trees of a model lie in one set of arrays: feature,
threshold, the place of the left child (the right one follows it) and the value of a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.2
LEAST_ROWS, RIDGE, LEAST_GAIN = 10, 1.0, 1e-6


@dataclass(frozen=True)
class Model:
    base: float
    roots: np.ndarray
    feature: np.ndarray  # -1 in a leaf
    threshold: np.ndarray  # greater values go right
    left: np.ndarray
    value: np.ndarray
    depth: int = DEPTH

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1: all rows walk down all trees, one level a step."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(feature < 0, at, self.left[at] + right)
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values that occur, at quantiles where there are many."""
    found = np.unique(column)
    if len(found) > bins:
        found = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
    return found[:-1]


def _leaf(g: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.clip(-g / (h + RIDGE), low, high)


def _score(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a leaf of value w takes off the loss, twice."""
    return -(2 * g * w + (h + RIDGE) * w * w)


def train(
    x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Model:
    """`directions` has 1, -1 or 0 per feature: the score may only rise, only fall, or either. Rows
    of one class, or no rows, give a model without trees."""
    share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(c, bins) for c in x.T]
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]  # v > edges[b] if b < bin
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        return len(feature) - 1

    margin = np.full(len(y), base)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        at = np.zeros(len(y), np.int64)  # place of each row among the nodes of the level; -1 in a leaf
        level, low, high = [roots[-1]], np.array([-np.inf]), np.array([np.inf])
        for deep in range(depth + 1):
            live, n = at >= 0, len(level)
            sums = [np.bincount(at[live], v[live], n) for v in (g, h)]
            best = np.full(n, LEAST_GAIN)
            chosen: list[tuple | None] = [None] * n
            whole = _score(*sums, _leaf(*sums, low, high))
            for f, edge in enumerate(edges if deep < depth else ()):
                if not len(edge):
                    continue
                slot, shape = at[live] * (len(edge) + 1) + binned[f][live], (n, len(edge) + 1)
                parts = [np.bincount(slot, v, n * shape[1]).reshape(shape).cumsum(1)[:, :-1] for v in (g[live], h[live], None)]
                gl, hl, nl = parts
                gr, hr = sums[0][:, None] - gl, sums[1][:, None] - hl
                nr = np.bincount(at[live], minlength=n)[:, None] - nl
                wl, wr = (_leaf(a, b, low[:, None], high[:, None]) for a, b in ((gl, hl), (gr, hr)))
                gain = _score(gl, hl, wl) + _score(gr, hr, wr) - whole[:, None]
                gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS) | (directions[f] * (wr - wl) < 0)] = -np.inf
                cut = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(n), cut] > best):
                    best[i], c = gain[i, cut[i]], cut[i]
                    chosen[i] = (f, int(c), (wl[i, c] + wr[i, c]) / 2)
            below, low_, high_, moved = [], [], [], np.full(len(y), -1)
            leaves = _leaf(*sums, low, high)
            for i, split in enumerate(chosen):
                if split is None:
                    value[level[i]] = rate * float(leaves[i])
                    margin[at == i] += value[level[i]]
                    continue
                f, c, middle = split
                feature[level[i]], threshold[level[i]] = f, float(edges[f][c])
                left[level[i]] = node()
                mine = at == i
                moved[mine] = len(below) + (binned[f][mine] > c)
                below += [left[level[i]], node()]
                bounds = [(low[i], high[i])] * 2
                if directions[f]:
                    halves = [(low[i], middle), (middle, high[i])]
                    bounds = halves if directions[f] > 0 else halves[::-1]
                low_ += [b[0] for b in bounds]
                high_ += [b[1] for b in bounds]
            level, low, high, at = below, np.array(low_), np.array(high_), moved
            if not level:
                break
    return Model(
        base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), depth
    )

"""Hierarchical navigable small-world graphs as flat arrays, built and searched in NumPy.

Nodes are inserted, and queries answered, many at a time: all beams of a batch take their next step
together. Vectors are compared by inner product. When a graph is built every vector x gets one more
component e that brings all to the same length R, so that the largest inner product is also the least
distance; a query has zero there. With one very long vector all e come close to R, and single
precision would drown their products x.y + e_x * e_y in R * R, which is the same for every pair. So
a = e - R is stored, found without cancellation as -|x|^2 / (e + R), and R * a, for
e_x * e_y - R * R = a_x * a_y + R * a_x + R * a_y.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16  # per node above the ground, twice as many on it
BUILD_BEAM = 96
STEP = 4  # nodes of a beam that are expanded at once
BATCH = 256
LONGEST = 64  # vectors of a graph that are held apart: they are near to everything and would draw every path
EXTRA = 3  # a, R * a and 1; a node that is compared with others has the last two the other way round


@dataclass
class Graph:
    """levels[0] is the top. Each has the nodes of the level and a row of neighbours per node, as
    places within the level, -1 where there is none."""

    vectors: np.ndarray  # float32, with the EXTRA components that even out lengths
    levels: list[tuple[np.ndarray, np.ndarray]]
    apart: np.ndarray  # the longest vectors, which are on no level: to be compared with every query

    def search(self, queries: np.ndarray, beam: int, k: int) -> np.ndarray:
        """Nodes of the levels nearest to each query, nearest first, -1 where there are fewer."""
        queries = np.concatenate([queries, np.zeros((len(queries), EXTRA), queries.dtype)], 1)
        found = np.full((len(queries), k), -1, np.int64)
        for start in range(0, len(queries), BATCH):
            some = queries[start : start + BATCH]
            entry = np.zeros((len(some), 1), np.int64)
            for depth, (nodes, links) in enumerate(self.levels):
                last = depth == len(self.levels) - 1
                ids, _ = _beams(self.vectors[nodes], links, len(nodes), some, entry, beam if last else 8)
                if last:
                    width = min(k, ids.shape[1])
                    found[start : start + len(some), :width] = np.where(ids[:, :width] >= 0, nodes[ids[:, :width]], -1)
                else:
                    entry = _entries(ids, nodes, self.levels[depth + 1][0])
        return found


def _asking(nodes: np.ndarray) -> np.ndarray:
    """Nodes as the other side of a comparison."""
    return np.concatenate([nodes[..., :-2], nodes[..., -1:], nodes[..., -2:-1]], -1)


def _products(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each row of `one` with its own rows in `many`."""
    return np.matmul(many, one[:, :, None])[:, :, 0]


def _entries(ids: np.ndarray, nodes: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Places on the next level of nodes found on this one; both lists of nodes are sorted."""
    return np.where(ids >= 0, np.searchsorted(below, nodes[ids]), -1)


def _beams(
    vectors: np.ndarray, links: np.ndarray, filled: int, queries: np.ndarray, entry: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: (places, similarities), nearest first, -1 and -inf for
    empty places. Only the first `filled` rows of the level are in the graph yet."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, filled + 1), bool)  # the last column takes the marks of empty places
    seen[:, filled] = True

    def unseen(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # of equal places in a row only the first counts
        order = np.argsort(places, 1, kind="stable")
        ranked = np.take_along_axis(places, order, 1)
        repeat = np.zeros_like(ranked, bool)
        repeat[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        ranked[repeat | seen[rows, ranked]] = -1
        seen[rows, ranked] = True
        near = _products(vectors[ranked], queries)
        return ranked, np.where(ranked >= 0, near, -np.inf)

    ids, near = unseen(np.where(entry < filled, entry, -1))
    done = ids < 0
    while True:
        order = np.argsort(-near, 1, kind="stable")[:, :beam]
        ids, near, done = (np.take_along_axis(x, order, 1) for x in (ids, near, done))
        if done.all():
            return ids, near
        rank = np.where(done, np.inf, np.arange(ids.shape[1])[None, :])
        step = np.argsort(rank, 1, kind="stable")[:, :STEP]
        chosen = np.take_along_axis(np.where(done, -1, ids), step, 1)
        np.put_along_axis(done, step, True, 1)
        next_ = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(n, -1)
        fresh, fresh_near = unseen(np.where(next_ < filled, next_, -1))
        ids, near = np.concatenate([ids, fresh], 1), np.concatenate([near, fresh_near], 1)
        done = np.concatenate([done, fresh < 0], 1)


def _spread(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each node at most `most` of its candidates (nearest first): one is taken if it is nearer
    to the node than to every one taken before; places left are filled with the nearest others."""
    n, width = candidates.shape
    apart = vectors[candidates]  # row, candidate, component
    between = np.matmul(apart, _asking(apart).transpose(0, 2, 1))  # all candidates of a row
    taken, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    closest = np.full((n, width), -np.inf)  # of each candidate to those taken
    for i in range(width):
        take = (candidates[:, i] >= 0) & (near[:, i] > closest[:, i]) & (count < most)
        if not take.any():
            continue
        taken[:, i] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, i]), closest)
    rank = np.where(candidates < 0, 3 * width, np.arange(width)[None, :] + np.where(taken, 0, width))
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    chosen = np.take_along_axis(candidates, order, 1)
    if chosen.shape[1] < most:
        chosen = np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)
    return chosen


def _link_level(vectors: np.ndarray, most: int, entries) -> np.ndarray:
    """Neighbours of one level. entries(start, stop) gives places to begin the search for new nodes."""
    n = len(vectors)
    links = np.full((n, most), -1, np.int64)
    start = 0
    while start < n:
        stop = min(n, start + (BATCH if start >= BATCH else BATCH - start))
        new = np.arange(start, stop)
        # nodes of a batch do not see each other in the graph yet, so they are compared directly
        mates = _asking(vectors[new]) @ vectors[new].T
        np.fill_diagonal(mates, -np.inf)
        width = min(BUILD_BEAM, max(1, len(new) - 1))
        top = np.argsort(-mates, 1, kind="stable")[:, :width]
        ids, near = new[top], np.take_along_axis(mates, top, 1)
        if len(new) == 1:
            ids = np.full_like(ids, -1)
        if start:
            old, old_near = _beams(vectors, links, start, _asking(vectors[new]), entries(start, stop), BUILD_BEAM)
            ids, near = np.concatenate([old, ids], 1), np.concatenate([old_near, near], 1)
            order = np.argsort(-near, 1, kind="stable")[:, :BUILD_BEAM]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        links[new] = _spread(vectors, new, ids, near, most)
        _link_back(vectors, links, new, most)
        start = stop
    return links


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
    """Gives the neighbours of new nodes a link in return; full rows are spread out anew."""
    source, target = np.repeat(new, most), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, first, count = np.unique(target, return_index=True, return_counts=True)
    width = most + int(count.max(initial=0))
    rows = np.full((len(at), width), -1, np.int64)
    rows[:, :most] = links[at]
    place = np.arange(len(target)) - np.repeat(first, count)
    rows[np.repeat(np.arange(len(at)), count), most + place] = source
    for begin in range(0, len(at), BATCH):
        part, own = rows[begin : begin + BATCH], at[begin : begin + BATCH]
        ranked = np.sort(part, 1)[:, ::-1]
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
        near = _products(vectors[ranked], _asking(vectors[own]))
        near = np.where(ranked >= 0, near, -np.inf)
        order = np.argsort(-near, 1, kind="stable")
        links[own] = _spread(vectors, own, np.take_along_axis(ranked, order, 1), np.take_along_axis(near, order, 1), most)


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """The graph of distinct vectors (float32, one per row)."""
    square = (vectors.astype(np.float64) ** 2).sum(1)
    count = min(LONGEST, len(vectors) // 8)
    order = np.argsort(square, kind="stable")
    apart, rest = np.sort(order[len(order) - count :]), np.sort(order[: len(order) - count])
    most = square[rest].max(initial=0)
    a = -square / (np.sqrt(np.maximum(most - square, 0)) + np.sqrt(most))
    extra = np.stack([a, np.sqrt(most) * a, np.ones_like(a)], 1).astype(np.float32)
    full = np.concatenate([vectors.astype(np.float32), extra], 1)
    n = len(rest)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(height.max(initial=0), -1, -1):
        nodes = rest[height >= depth]

        def entries(start: int, stop: int, nodes=nodes) -> np.ndarray:
            entry = np.zeros((stop - start, 1), np.int64)
            for i, (upper, links) in enumerate(levels):
                below = levels[i + 1][0] if i + 1 < len(levels) else nodes
                ids, _ = _beams(full[upper], links, len(upper), _asking(full[nodes[start:stop]]), entry, 8)
                entry = _entries(ids, upper, below)
            # the first node is in the graph in any case
            return np.concatenate([entry, np.zeros((stop - start, 1), np.int64)], 1)

        levels.append((nodes, _link_level(full[nodes], LINKS * (2 if depth == 0 else 1), entries)))
    return Graph(full, levels, apart)

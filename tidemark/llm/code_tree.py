"""Nearest entry of a codebook by a tree of split points that keep their children's distance ranges."""

from __future__ import annotations

import numpy as np

DEGREE, LEAF = 16, 16  # children of a node, entries that are not split further
EXACT = 1 << 52  # whole numbers below it are exact as doubles


def squared_distances(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors, queries by entries.

    Doubles while every sum stays within what they hold exactly, Python's numbers beyond it.
    """
    if queries.dtype != object and entries.dtype != object:
        size = max(int(np.abs(some).max(initial=0)) for some in (queries, entries))
        if 4 * size * size * max(1, queries.shape[1]) < EXACT:
            q, e = queries.astype(np.float64), entries.astype(np.float64)
            return (q * q).sum(axis=1)[:, None] - 2 * (q @ e.T) + (e * e).sum(axis=1)[None, :]
    q, e = queries.astype(object), entries.astype(object)
    parts = [((q - entry) ** 2).sum(axis=1, initial=0) for entry in e]
    return np.array(parts, dtype=object).reshape(len(e), len(q)).T


def _below(squared: np.ndarray) -> np.ndarray:
    """Not more than the root of exact squares."""
    return np.sqrt(squared.astype(np.float64)) * (1 - 1e-12)


def _above(squared: np.ndarray) -> np.ndarray:
    """Not less than the root of exact squares."""
    return np.sqrt(squared.astype(np.float64)) * (1 + 1e-12)


class CodeTree:
    """A geometric near-neighbour access tree over the entries of one codebook.

    A node has split points, which are entries, and one child per split point with the entries that
    are nearest to it. It keeps the least and largest distance of every split point to every child's
    entries. A query that is farther from such a range than its best distance so far can find nothing
    as near in that child: distances below are rounded down, those above up, and only a strictly
    greater distance rules a child out, so that ties are never lost. What remains is compared in
    whole numbers, ties to the lower index.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))
        self.compared = 0  # pairs of a query and an entry whose distance was taken

    def _node(self, members: np.ndarray):
        if len(members) <= max(LEAF, DEGREE):
            return members
        # Split points far from each other: each next one is the farthest from those before.
        chosen = [0]
        nearest = squared_distances(self.entries[members], self.entries[members[:1]])[:, 0]
        while len(chosen) < DEGREE:
            far = int(np.argmax(nearest))
            if not nearest[far]:
                return members  # fewer different entries than children
            chosen.append(far)
            fresh = squared_distances(self.entries[members], self.entries[members[far : far + 1]])[:, 0]
            nearest = np.minimum(nearest, fresh)
        points = members[chosen]
        rest = np.delete(members, chosen)
        distances = squared_distances(self.entries[points], self.entries[rest])
        owner = np.argmin(distances, axis=0)
        children, low, high = [], np.full((DEGREE, DEGREE), np.inf), np.full((DEGREE, DEGREE), -np.inf)
        for number in range(DEGREE):
            own = owner == number
            children.append(self._node(rest[own]) if own.any() else None)
            if own.any():
                low[:, number] = _below(distances[:, own].min(axis=1))
                high[:, number] = _above(distances[:, own].max(axis=1))
        return points, children, low, high

    def _compare(self, queries, active, members, best, index) -> np.ndarray:
        """Takes the distances to some entries and keeps the best of each query."""
        distances = squared_distances(queries[active], self.entries[members])
        self.compared += distances.size
        order = np.argsort(members)
        at = np.argmin(distances[:, order], axis=1)
        found, which = distances[np.arange(len(active)), order[at]], members[order[at]]
        old, old_index = best[active], index[active]
        better = (found < old) | ((found == old) & (which < old_index))
        best[active[better]], index[active[better]] = found[better], which[better]
        return distances

    def _search(self, node, queries, active, best, index) -> None:
        if isinstance(node, np.ndarray):
            self._compare(queries, active, node, best, index)
            return
        points, children, low, high = node
        distances = self._compare(queries, active, points, best, index)
        lower, upper = _below(distances), _above(distances)
        # First every query in the child of its nearest split point: what it finds there makes its
        # reach small. Then each other child with those queries that it may still hold something for.
        nearest = np.argmin(distances, axis=1)
        for number, child in enumerate(children):
            mine = np.flatnonzero(nearest == number)
            if child is not None and len(mine):
                self._search(child, queries, active[mine], best, index)
        for number, child in enumerate(children):
            if child is None:
                continue
            reach = _above(best[active])[:, None]
            ruled_out = (lower - reach > high[:, number]) | (upper + reach < low[:, number])
            mine = np.flatnonzero(~ruled_out.any(axis=1) & (nearest != number))
            if len(mine):
                self._search(child, queries, active[mine], best, index)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance to it) of each query."""
        large = queries.dtype == object or self.entries.dtype == object
        best = np.full(len(queries), np.inf, object if large else np.float64)
        index = np.full(len(queries), len(self.entries))
        if len(queries):
            self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

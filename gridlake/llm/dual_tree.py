"""Trees over vectors, and the largest inner products between two of them inside score intervals.

A tree's nodes are balls (centre, radius) over a run of rows.  For an anchor node a and a candidate node b
every inner product lies within ``<ca, cb> +- (|ca| rb + |cb| ra + ra rb)``; a node pair whose interval misses
all that the anchors of a still ask for is pruned at once, and pairs of leaves are scored exactly.  Node
pairs are taken by falling upper end, so that requests fill up, and their lower ends rise, early.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

FAR = 1 << 62
FEW_LABELS = 64


class Tree:
    """Balls over rows in the order ``order``; the uppermost ones hold one label each where there are few labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, leaf: int):
        found, code = np.unique(labels, return_inverse=True)
        pure = len(found) <= FEW_LABELS
        self.order = np.argsort(code, kind="stable") if pure else np.arange(len(rows))
        cuts = np.searchsorted(code[self.order], np.arange(len(found) + 1)) if pure else np.array([0, len(rows)])
        self.first, self.last, self.child, self.label, self.centre, self.radius = [], [], [], [], [], []
        self.roots = [self._grow(rows, int(a), int(b), leaf, found[i] if pure else None) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        self.norm = [float(np.linalg.norm(c)) for c in self.centre]

    def _node(self, rows: np.ndarray, a: int, b: int, label) -> tuple[int, np.ndarray]:
        part = rows[self.order[a:b]]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        for held, new in ((self.first, a), (self.last, b), (self.child, None), (self.label, label), (self.centre, centre), (self.radius, float(away.max()))):
            held.append(new)
        return len(self.first) - 1, away

    def _grow(self, rows: np.ndarray, a: int, b: int, leaf: int, label) -> int:
        root, away = self._node(rows, a, b, label)
        todo = [(root, away)]
        while todo:
            node, away = todo.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= leaf or self.radius[node] == 0:
                continue
            part = rows[self.order[a:b]]
            one = part[away.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part @ (two - one), half)]
            both = [self._node(rows, a, a + half, label), self._node(rows, a + half, b, label)]
            self.child[node] = [n for n, _ in both]
            todo += both
        return root


def interval(centre_a, norm_a, radius_a, centre_b, norm_b, radius_b) -> tuple[float, float]:
    """Bounds of the inner products of two balls' rows, widened for rounding."""
    middle = float(centre_a @ centre_b)
    reach = norm_a * radius_b + norm_b * radius_a + radius_a * radius_b
    reach += 1.0 + 1e-9 * (reach + norm_a * norm_b)
    return middle - reach, middle + reach


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, held within +-(2^63 - 1)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * max(1, int(np.abs(a).max())) * max(1, int(np.abs(b).max()))
    if most < 1 << 53:
        return a.astype(float) @ b.T.astype(float)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


@dataclass
class Requests:
    """One row a request: its anchor (falling into runs), the score interval, and what was found."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self):
        self.low = self.low.copy()
        self.found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.low)

    def offer(self, r: int, scores: np.ndarray, ids: np.ndarray, most: int) -> None:
        s, i = np.concatenate([self.found[r][0], scores]), np.concatenate([self.found[r][1], ids])
        top = np.lexsort((i, -s))[:most]
        self.found[r] = s[top], i[top]
        if len(top) == most:
            self.low[r] = max(self.low[r], s[top[-1]])


class Candidates:
    """Integer rows with ids and labels under a tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = 512):
        self.tree = Tree(rows.astype(float), labels, leaf) if len(rows) else None
        order = self.tree.order if len(rows) else slice(None)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]

    def search(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, wants: Requests, same: bool, most: int, leaf: int = 32) -> int:
        """Fills ``wants`` with the best rows of the anchors' own label, or of other labels; gives the number of leaf pairs scored.

        A row of the anchor's id is no candidate.  Best is the largest score, then the smallest id.
        """
        if self.tree is None or not len(rows) or not len(wants.low):
            return 0
        mine, there = Tree(rows.astype(float), labels, leaf), self.tree
        place = np.argsort(mine.order)[wants.anchor]
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(len(rows) + 1))
        heap: list = []

        def asked(a: int) -> np.ndarray:
            return by_place[cuts[mine.first[a]] : cuts[mine.last[a]]]

        def put(a: int, b: int) -> None:
            if mine.label[a] is not None and there.label[b] is not None and (mine.label[a] == there.label[b]) != same:
                return
            low, high = interval(mine.centre[a], mine.norm[a], mine.radius[a], there.centre[b], there.norm[b], there.radius[b])
            r = asked(a)
            if len(r) and high >= wants.low[r].min() and low <= wants.high[r].max():
                heapq.heappush(heap, (-high, a, b))

        for a in mine.roots:
            for b in there.roots:
                put(a, b)
        scored = 0
        while heap:
            high, a, b = heapq.heappop(heap)
            r = asked(a)
            if -high < wants.low[r].min():
                continue
            if mine.child[a] is None and there.child[b] is None:
                scored += 1
                self._score(r, place[r], mine, a, b, (ids, labels, rows), wants, same, most)
            elif there.child[b] is None or mine.child[a] is not None and mine.radius[a] > there.radius[b]:
                for c in mine.child[a]:
                    put(c, b)
            else:
                for c in there.child[b]:
                    put(a, c)
        return scored

    def _score(self, r, place, mine, a, b, anchors, wants, same, most) -> None:
        ids, labels, rows = anchors
        at = mine.order[mine.first[a] : mine.last[a]]
        here = slice(self.tree.first[b], self.tree.last[b])
        s = products(rows[at], self.rows[here])
        fits = (labels[at][:, None] == self.labels[here]) == same
        fits &= ids[at][:, None] != self.ids[here]
        row = place - mine.first[a]
        ok = fits[row] & (s[row] >= wants.low[r][:, None]) & (s[row] <= wants.high[r][:, None])
        for k in np.flatnonzero(ok.any(axis=1)):
            hit = np.flatnonzero(ok[k])
            wants.offer(int(r[k]), s[row[k], hit].astype(np.int64), self.ids[here][hit], most)


class Cells:
    """Leaf cells of a tree fitted on a sample; ``route`` finds each row's cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.line = np.zeros((1 << depth, sample.shape[1]))
        self.cut = np.zeros(1 << depth)
        self.centre = np.zeros((1 << depth, sample.shape[1]))
        where = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            part = where.pop(node)
            if len(part) > 1:
                x = sample[part]
                one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                two = x[((x - one) ** 2).sum(axis=1).argmax()]
                self.line[node] = two - one
                along = x @ self.line[node]
                self.cut[node] = np.median(along)
                right = along > self.cut[node]
            else:
                right = np.zeros(len(part), bool)
            where[2 * node], where[2 * node + 1] = part[~right], part[right]
        for node, part in where.items():
            if len(part):
                self.centre[node - (1 << depth)] = sample[part].mean(axis=0)

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to the cell's centre) of each row."""
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((rows * self.line[node]).sum(axis=1) > self.cut[node])
        cell = node - (1 << self.depth)
        return cell, np.sqrt(((rows - self.centre[cell]) ** 2).sum(axis=1))

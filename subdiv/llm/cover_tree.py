"""Cover tree over the unit vectors of one block, and the dual traversal of two of them.

A node's children are a net of its points: more than r apart, every point with its nearest
one, r the largest power of two that gives two children.  The node's own center is one of
them, so levels are nested.  Every node knows the radius that covers all its points.  Two
nodes whose balls are too far apart hold no link and are passed over; two nodes whose balls
lie close enough hold nothing but links and are taken whole; all others are opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounding of distances made from inner products; bounds must hold by this much.
SLACK = 1e-6
#: Point pairs of two nodes that are compared rather than opened.
SMALL = 256


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, all pairs."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def level_radius(spread: float) -> float:
    """The largest power of two below ``spread``."""
    r = 2.0 ** np.floor(np.log2(spread))
    return r if r < spread else r / 2


@dataclass
class CoverTree:
    order: np.ndarray  # position in the tree -> row
    low: np.ndarray  # of each node, its points' positions
    high: np.ndarray
    center: np.ndarray  # row
    radius: np.ndarray
    first_child: np.ndarray
    children: np.ndarray  # number; 0 for single points and for points in one place

    @classmethod
    def of(cls, vectors: np.ndarray) -> CoverTree:
        n = len(vectors)
        far = distance(vectors, vectors)  # a block is bounded
        order = np.arange(n)
        low, high, center, radius, first, count = [0], [n], [0], [float(far[0].max()) if n else 0.0], [0], [0]
        at = 0
        while at < len(low):
            rows, c, spread = order[low[at] : high[at]], center[at], radius[at]
            if len(rows) > 1 and spread > SLACK:
                r, net = level_radius(spread), [c]
                open_rows = far[c, rows] > r
                while open_rows.any():
                    new = rows[np.argmax(open_rows)]
                    net.append(new)
                    open_rows &= far[new, rows] > r
                net = np.array(net)
                nearest = np.argmin(far[np.ix_(net, rows)], axis=0)
                by_child = np.argsort(nearest, kind="stable")
                order[low[at] : high[at]] = rows[by_child]
                sizes = np.bincount(nearest, minlength=len(net))
                ends = low[at] + np.cumsum(sizes)
                first[at], count[at] = len(low), len(net)
                for child, size, end in zip(net.tolist(), sizes.tolist(), ends.tolist()):
                    low.append(end - size)
                    high.append(end)
                    center.append(child)
                    radius.append(0.0 if size == 1 else float(far[child, order[end - size : end]].max()))
                    first.append(0)
                    count.append(0)
            at += 1
        return cls(order, *(np.array(x) for x in (low, high, center, radius, first, count)))


class Links:
    """What a dual traversal finds: weight linked to each position, and pairs that join components."""

    def __init__(self, one: CoverTree, other: CoverTree, w_one: np.ndarray, w_other: np.ndarray):
        self.one, self.other = one, other
        self.step = [np.zeros(len(w) + 1, dtype=np.int64) for w in (w_one, w_other)]
        self.weight = [np.concatenate([[0], np.cumsum(w[t.order])]) for t, w in ((one, w_one), (other, w_other))]
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        """All points of nodes ``a[i]`` are linked with all of ``b[i]``."""
        for side, (tree, x), (others, y) in ((0, (self.one, a), (self.other, b)), (1, (self.other, b), (self.one, a))):
            total = self.weight[1 - side]
            linked = total[others.high[y]] - total[others.low[y]]
            np.add.at(self.step[side], tree.low[x], linked)
            np.subtract.at(self.step[side], tree.high[x], linked)
        # a complete bipartite part is held together by its first rows
        self.joined.append((self.one.low[a], self.other.low[b]))
        for tree, x, flip in ((self.one, a, False), (self.other, b, True)):
            many = np.unique(x[tree.high[x] - tree.low[x] > 1])
            if len(many):
                size = tree.high[many] - tree.low[many]
                inner = np.arange(size.sum()) + np.repeat(tree.low[many] - np.cumsum(size) + size, size)
                self.joined.append((np.repeat(tree.low[many], size), inner, flip))  # type: ignore[arg-type]

    def single(self, a: np.ndarray, b: np.ndarray) -> None:
        """Positions ``a[i]`` and ``b[i]`` are linked."""
        for side, (x, y) in ((0, (a, b)), (1, (b, a))):
            total = self.weight[1 - side]
            linked = total[y + 1] - total[y]
            np.add.at(self.step[side], x, linked)
            np.subtract.at(self.step[side], x + 1, linked)
        self.joined.append((a, b))

    def counts(self, side: int) -> np.ndarray:
        """Weight linked to each row."""
        tree = (self.one, self.other)[side]
        out = np.zeros(len(tree.order), dtype=np.int64)
        out[tree.order] = np.cumsum(self.step[side])[:-1]
        return out

    def groups(self) -> np.ndarray:
        """Smallest point of each point's component; rows of ``one`` first, then those of ``other``."""
        n = len(self.one.order)
        row = [self.one.order, n + self.other.order]
        pairs = [(row[x[2]][x[0]], row[x[2]][x[1]]) if len(x) == 3 else (row[0][x[0]], row[1][x[1]]) for x in self.joined]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
        root = np.arange(n + len(self.other.order))
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
        return root


def traverse(one: CoverTree, x: np.ndarray, other: CoverTree, y: np.ndarray, w_one: np.ndarray, w_other: np.ndarray, cosine: float) -> Links:
    """Every pair of a row of ``x`` and a row of ``y`` whose cosine is at least ``cosine``."""
    reach = float(np.sqrt(2 - 2 * cosine))
    found = Links(one, other, w_one, w_other)
    todo = [(0, 0)] if len(x) and len(y) else []
    while todo:
        a, b = todo.pop()
        if not one.children[a] and not other.children[b]:
            rows, columns = one.order[one.low[a] : one.high[a]], other.order[other.low[b] : other.high[b]]
            i, j = np.nonzero(x[rows] @ y[columns].T >= cosine)
            found.single(one.low[a] + i, other.low[b] + j)
            continue
        left = np.arange(one.first_child[a], one.first_child[a] + one.children[a]) if one.children[a] else np.array([a])
        right = np.arange(other.first_child[b], other.first_child[b] + other.children[b]) if other.children[b] else np.array([b])
        cosines = x[one.center[left]] @ y[other.center[right]].T
        apart = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        both = one.radius[left][:, None] + other.radius[right][None, :]
        single = (one.high[left] - one.low[left] == 1)[:, None] & (other.high[right] - other.low[right] == 1)[None, :]
        i, j = np.nonzero(single & (cosines >= cosine))
        found.single(one.low[left[i]], other.low[right[j]])
        inside = ~single & (apart + both < reach - SLACK)
        i, j = np.nonzero(inside)
        if len(i):
            found.whole(left[i], right[j])
        i, j = np.nonzero(~single & ~inside & (apart - both <= reach + SLACK))
        i, j = left[i], right[j]
        small = (one.high[i] - one.low[i]) * (other.high[j] - other.low[j]) <= SMALL
        _decide(found, x, y, i[small], j[small], cosine)
        todo += zip(i[~small].tolist(), j[~small].tolist())
    return found


def _decide(found: Links, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> None:
    """Compare the points of pairs of small nodes, many pairs at a time."""
    one, other = found.one, found.other
    for lo in range(0, len(a), 256):
        p, q = a[lo : lo + 256], b[lo : lo + 256]
        n_p, n_q = one.high[p] - one.low[p], other.high[q] - other.low[q]
        size = n_p * n_q
        pair = np.repeat(np.arange(len(p)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = one.low[p][pair] + at // n_q[pair], other.low[q][pair] + at % n_q[pair]
        linked = np.einsum("ij,ij->i", x[one.order[i]], y[other.order[j]]) >= cosine
        found.single(i[linked], j[linked])

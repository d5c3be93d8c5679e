"""A vantage-point tree over points on the unit sphere, with batched radius search."""

from __future__ import annotations

import numpy as np

LEAF = 24
#: Slack on tree bounds, in radians, far above rounding and far below any radius of use.
SLACK = 1e-12


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Degrees to unit vectors."""
    lat, lon = np.radians(np.asarray(lat, np.float64)), np.radians(np.asarray(lon, np.float64))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle angle between rows of two arrays; exact for close points too, unlike the arc cosine."""
    chord = np.sqrt(np.square(a - b).sum(axis=-1))
    return 2 * np.arcsin(np.minimum(chord / 2, 1))


class VPTree:
    """Points split by their distance from a vantage point, down to leaves of ``LEAF`` points.

    ``within`` answers a batch of radius queries level by level: the frontier holds (query, node) pairs,
    and the triangle inequality decides which children can hold hits.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        self.order, nodes, todo = order, [], [(0, len(points), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = at
            if high - low <= LEAF:
                nodes.append([low, high, -1.0, -1, -1, -1])
                continue
            part = order[low:high]
            first = part[0]
            far = part[np.argmax(angle(points[part], points[first][None]))]
            d = angle(points[part], points[far][None])
            middle = (high - low) // 2
            by = np.argpartition(d, middle)
            order[low:high] = part[by]
            nodes.append([low, high, float(d[by[middle]]), -1, -1, far])
            todo += [(low, low + middle, at, 0), (low + middle, high, at, 1)]
        table = np.array(nodes, dtype=np.float64).reshape(-1, 6)
        self.low, self.high, self.inner, self.outer, self.vantage = (table[:, i].astype(np.int64) for i in (0, 1, 3, 4, 5))
        self.mu = table[:, 2]

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, point number) at most ``radius[query]`` radians apart."""
        if not len(self.points) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, node, found_q, found_p = np.arange(len(queries)), np.zeros(len(queries), np.int64), [], []
        while len(q):
            leaf = self.mu[node] < 0
            if leaf.any():
                lq, ln = q[leaf], node[leaf]
                sizes = self.high[ln] - self.low[ln]
                each = np.repeat(np.arange(len(ln)), sizes)
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                p = self.order[self.low[ln][each] + within]
                hit = angle(queries[lq[each]], self.points[p]) <= radius[lq[each]]
                found_q.append(lq[each][hit])
                found_p.append(p[hit])
            q, node = q[~leaf], node[~leaf]
            d, mu, r = angle(queries[q], self.points[self.vantage[node]]), self.mu[node], radius[q] + SLACK
            inner, outer = d <= mu + r, d >= mu - r
            q, node = np.concatenate([q[inner], q[outer]]), np.concatenate([self.inner[node[inner]], self.outer[node[outer]]])
        return np.concatenate(found_q or [np.empty(0, np.int64)]), np.concatenate(found_p or [np.empty(0, np.int64)])

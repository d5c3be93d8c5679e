"""A robust-pruned directed graph over unit vectors, built and searched for many queries at once.

Greedy searches over the graph so far propose the neighbours of the points that enter it; pruning keeps
an edge only if no kept neighbour is nearer to the candidate by the factor ``alpha``, so the edges
point in diverse directions. All searches of a batch move in lockstep, which makes every step a numpy
operation over the whole batch.
"""

from __future__ import annotations

import numpy as np


class RobustGraph:
    """The graph over the rows of ``vectors`` (unit length, float32). Distances are 1 - cosine, half the squared chord.

    A point gets ``degree`` pruned out-edges at most; edges back to it are added while there is ``room``, and
    only then is it pruned again. ``beam`` is the width of the searches that build the graph, ``width`` the number of
    points a search expands in one step, ``entries`` the number of spread points where searches begin, and ``alpha``
    the pruning factor on chords. What the searches find is noted at both ends: ``near`` and ``far`` hold the
    ``keep`` nearest points each point has met so far. Everything is deterministic.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 24, beam: int = 24, alpha: float = 1.05, entries: int = 512, batch: int = 1024, width: int = 12, step: int = 512, room: int = 36, keep: int = 16):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = self.n = len(vectors)
        self.degree, self.room, self.keep, self.width, self.step, self.factor = degree, room, keep, width, step, alpha * alpha
        self.flat = np.int32 if step * n < 2**31 else np.int64
        # which points the searches of a batch have met: cleared where it was set, not as a whole
        self.seen = np.zeros(step * n, bool)
        self.edges, self.count = np.full((n, room), -1, np.int32), np.zeros(n, np.int32)
        self.near, self.far = np.full((n, keep), -1, np.int32), np.full((n, keep), np.inf, np.float32)
        order = np.random.default_rng(0).permutation(n).astype(np.int32)
        at = min(n, 2 * degree)
        self.entries = order[: min(n, entries)]
        self._join(order[:at], np.broadcast_to(order[:at], (at, at)))
        while at < n:
            new = order[at : at + min(batch, max(2 * degree, at // 2))]
            found, dist = self.search(self.x[new], beam, self.entries if at >= len(self.entries) else order[:at])
            self._note(new, found, dist)
            self._join(new, found)
            at += len(new)

    def _note(self, nodes: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
        """Write what the searches of ``nodes`` found to their lists, and the nodes to the lists of what they found."""
        kept = min(self.keep, found.shape[1])
        self.near[nodes, :kept], self.far[nodes, :kept] = found[:, :kept], dist[:, :kept]
        row, slot = np.nonzero(dist < self.far[found, -1])
        target, source, d = found[row, slot], nodes[row], dist[row, slot]
        order = np.lexsort((source, d, target))
        target, source, d = target[order], source[order], d[order]
        touched, start, many = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(start, many)
        few = rank < self.keep
        at, rank = np.repeat(np.arange(len(touched)), many)[few], rank[few]
        ids = np.full((len(touched), int(rank.max(initial=0)) + 1), -1, np.int32)
        far = np.full(ids.shape, np.inf, np.float32)
        ids[at, rank], far[at, rank] = source[few], d[few]
        far = np.concatenate([self.far[touched], far], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, : self.keep]
        self.near[touched] = np.take_along_axis(np.concatenate([self.near[touched], ids], axis=1), order, 1)
        self.far[touched] = np.take_along_axis(far, order, 1)

    def _join(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Out-edges from ``nodes`` to their pruned candidates, and edges back; a point whose room is used up is pruned again."""
        edges = self._prune(nodes, candidates)
        self.edges[nodes, : self.degree], self.count[nodes] = edges, (edges >= 0).sum(axis=1)
        row, slot = np.nonzero(edges >= 0)
        target, source = edges[row, slot], nodes[row]
        fresh = ~(self.edges[target] == source[:, None]).any(axis=1)
        target, source = target[fresh], source[fresh]
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        touched, start, many = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(start, many)
        fits = self.count[touched] + many <= self.room
        each = np.repeat(fits, many)
        self.edges[target[each], self.count[target[each]] + rank[each]] = source[each]
        self.count[touched[fits]] += many[fits].astype(np.int32)
        full = touched[~fits]
        if len(full):
            back = np.full((len(full), int(many[~fits].max())), -1, np.int32)
            back[np.searchsorted(full, target[~each]), rank[~each]] = source[~each]
            pruned = self._prune(full, np.concatenate([self.edges[full], back], axis=1))
            self.edges[full] = -1
            self.edges[full, : self.degree], self.count[full] = pruned, (pruned >= 0).sum(axis=1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of a row of candidates for each node; -1 is no candidate."""
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        step = max(1, self.step * 64 // max(64, candidates.shape[1]))
        for i in range(0, len(nodes), step):
            own, c = nodes[i : i + step], np.sort(candidates[i : i + step], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            c[c == own[:, None]] = -1
            v = self.x[c]
            d = 1 - np.matmul(v, self.x[own][:, :, None])[:, :, 0]
            d[c < 0] = np.inf
            between = np.matmul(v, v.transpose(0, 2, 1))
            np.subtract(1, between, out=between)
            between *= self.factor
            left, rows = d.copy(), np.arange(len(own))
            for slot in range(self.degree):
                best = left.argmin(axis=1)
                some = np.isfinite(left[rows, best])
                if not some.any():
                    break
                kept[i + rows[some], slot] = c[rows[some], best[some]]
                left[between[rows, best] <= d] = np.inf
                left[rows, best] = np.inf
        return kept

    def search(self, queries: np.ndarray, beam: int, starts: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of every query: the ``beam`` nearest points found and their distances, nearest first; -1 fills up.

        A search begins at the ``starts`` (by default the entries) nearest to its query, or, where the query is the point ``own`` of the graph,
        at that and the points noted for it.
        """
        parts = [self._walk(queries[i : i + self.step], beam, self.entries if starts is None else starts, None if own is None else own[i : i + self.step]) for i in range(0, len(queries), self.step)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.empty((0, beam), np.int32), np.empty((0, beam), np.float32))

    def _walk(self, q: np.ndarray, beam: int, starts: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m = len(q)
        live = np.arange(m)
        ids, dist = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32)
        if own is None:
            d = 1 - q @ self.x[starts].T
            take = min(beam, len(starts), 8)
            near = np.argpartition(d, take - 1, axis=1)[:, :take]
            ids[:, :take], dist[:, :take] = starts[near], np.take_along_axis(d, near, 1)
        else:
            take = min(beam - 1, self.keep)
            ids[:, 0], dist[:, 0] = own, 0
            ids[:, 1 : take + 1], dist[:, 1 : take + 1] = self.near[own, :take], self.far[own, :take]
        row, slot = np.nonzero(ids >= 0)
        met = [row * self.n + ids[row, slot]]
        seen = self.seen
        seen[met[0]] = True
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        done, place, width = ~np.isfinite(dist), live.copy(), min(self.width, beam)
        out_ids, out_dist = ids.copy(), dist.copy()
        while True:
            go = ~done.all(axis=1)
            if not go.all():
                stopped = ~go
                out_ids[live[stopped]], out_dist[live[stopped]] = ids[stopped], dist[stopped]
                live, ids, dist, done, q = live[go], ids[go], dist[go], done[go], q[go]
                if not len(live):
                    for flat in met:
                        seen[flat] = False
                    return out_ids, out_dist
                place[live] = np.arange(len(live))
            todo = ~done
            row, slot = np.nonzero(todo & (np.cumsum(todo, axis=1, dtype=np.int16) <= width))
            near = self.edges[ids[row, slot]]
            done[row, slot] = True
            flat = (live[row].astype(self.flat) * self.flat(self.n))[:, None] + near
            flat = flat[near >= 0]
            flat = np.sort(flat[~seen[flat]])
            if not len(flat):
                continue
            flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])]
            seen[flat] = True
            met.append(flat)
            at, target = np.divmod(flat, self.flat(self.n))
            row = place[at]
            d = 1 - np.einsum("kd,kd->k", self.x.take(target, axis=0), np.repeat(q, np.bincount(row, minlength=len(live)), axis=0))
            worth = d < dist[row, -1]
            row, target, d = row[worth], target[worth], d[worth]
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(live))
            column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more = (len(live), int(count.max()))
            new_ids, new_dist = np.full(more, -1, np.int32), np.full(more, np.inf, np.float32)
            new_ids[row, column], new_dist[row, column] = target, d
            dist = np.concatenate([dist, new_dist], axis=1)
            order = np.argsort(dist, axis=1)[:, :beam]
            # an id and whether it is done move as one number
            both = np.concatenate([ids * 2 + done, new_ids * 2], axis=1)
            order += np.arange(len(live))[:, None] * both.shape[1]
            dist, both = dist.take(order), both.take(order)
            ids, done = both >> 1, (both & 1).astype(bool) | ~np.isfinite(dist)

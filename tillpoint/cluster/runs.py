"""Nearest points by boxes over runs of a space-filling order, in numpy.

Points are sorted by key and by the interleaved bits of their coordinates, so
neighbours in the order are mostly neighbours in space, dense or sparse alike.
``RUN`` consecutive points share a bounding box, ``FAN`` boxes the next one up.
A query descends from the top: a box is left out when its nearest corner is
beyond the best bound on the query's k-th distance; the bound itself shrinks
on the way, by the farthest corners of boxes that hold k points together. A run
adapts to the local density, so the work per query is about that of the depth.
"""

from __future__ import annotations

import numpy as np

RUN, FAN = 8, 8
QUERIES = 1024  # that descend together


def interleaved(x: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Sort codes of points: each coordinate's place among its dimension's break points (and between two of them),
    bits interleaved. Only the balance of runs depends on the breaks."""
    d = x.shape[1]
    bits = 62 // d
    fine = max(0, bits - int(np.ceil(np.log2(len(breaks[0]) + 1))))
    out = np.zeros(len(x), np.int64)
    for i in range(d):
        b = breaks[i]
        place = np.searchsorted(b, x[:, i], side="right")
        low, high = b[np.maximum(place - 1, 0)], b[np.minimum(place, len(b) - 1)]
        with np.errstate(all="ignore"):
            part = np.nan_to_num((x[:, i] - low) / (high - low), nan=0.0, posinf=0.0, neginf=0.0)
        code = (place.astype(np.int64) << fine) | np.clip((part * (1 << fine)).astype(np.int64), 0, (1 << fine) - 1)
        for k in range(bits):
            out |= ((code >> k) & 1) << (k * d + i)
    return out


def kth_value(q: np.ndarray, value: np.ndarray, w: np.ndarray, queries: int, k: int) -> np.ndarray:
    """For each query, the least value up to which its items weigh k or more; infinite without."""
    out = np.full(queries, np.inf)
    if not len(q):
        return out
    order = np.lexsort((value, q))
    q, value, w = q[order], value[order], w[order]
    total = np.cumsum(w)
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    before = np.repeat((total - w)[head], np.diff(np.append(head, len(q))))
    enough = np.flatnonzero(total - before >= k)
    first = enough[np.concatenate([[True], q[enough][1:] != q[enough][:-1]])] if len(enough) else enough
    out[q[first]] = value[first]
    return out


class Runs:
    """Weighted items, points or boxes (``hi`` given), in sorted order; ``key`` limits who is near whom."""

    def __init__(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray | None, w: np.ndarray, run: int = RUN):
        hi = lo if hi is None else hi
        self.levels = [(lo, hi, key.reshape(len(lo), -1)[:, :1], key.reshape(len(lo), -1)[:, -1:], w)]
        self.fans = []
        fan = run
        while len(self.levels[-1][0]) > FAN:
            lo, hi, klo, khi, w = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(klo, at),
                                np.maximum.reduceat(khi, at), np.add.reduceat(w, at)))
            self.fans.append(fan)
            fan = FAN

    def near(self, key: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, squared distance to its nearest corner, bound on the query's k-th squared distance): the items
        that can hold a point nearer than or at the bound, by query."""
        q_out, i_out, d_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        bound = np.full(len(x), np.inf) if bound is None else bound.copy()
        for at in range(0, len(x), QUERIES):
            q, i, gap = self._descend(key[at:at + QUERIES], x[at:at + QUERIES], k, bound[at:at + QUERIES])
            q_out.append(q + at)
            i_out.append(i)
            d_out.append(gap)
        return np.concatenate(q_out), np.concatenate(i_out), np.concatenate(d_out), bound

    def _descend(self, key, x, k, bound):
        """``bound`` (a view) shrinks on the way."""
        n = len(self.levels[-1][0])
        q, i = np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))
        for level in range(len(self.levels) - 1, -1, -1):
            lo, hi, klo, khi, w = self.levels[level]
            same = (klo[i, 0] <= key[q]) & (khi[i, 0] >= key[q])
            q, i = q[same], i[same]
            gap, far = 0.0, 0.0
            for c in range(x.shape[1]):
                v = x[q, c]
                g, f = np.maximum(np.maximum(lo[i, c] - v, v - hi[i, c]), 0.0), np.maximum(v - lo[i, c], hi[i, c] - v)
                gap, far = gap + g * g, far + f * f
            alone = (klo[i, 0] == khi[i, 0])
            np.minimum(bound, kth_value(q[alone], far[alone], w[i[alone]], len(x), k), out=bound)
            keep = gap <= bound[q]
            q, i, gap = q[keep], i[keep], gap[keep]
            if level:
                fan, below = self.fans[level - 1], len(self.levels[level - 1][0])
                child = i[:, None] * fan + np.arange(fan)
                real = child < below
                q, i = np.broadcast_to(q[:, None], child.shape)[real], child[real]
        return q, i, gap

"""Exact DBSCAN of one bounded group of points inside one task (G5), in numpy.

The same grids, boxes and rules as ``dbscan.py`` on the helpers of ``tiles.py``, for keys whose rows one task can hold
(a batch of the chunked reader): nothing is exchanged or stored between its steps.
"""

from __future__ import annotations

import math

import numpy as np

from tillpoint.cluster import tiles

PAIRS = 1 << 20  # point pairs compared at a time


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's group of equal rows, and the order and starts of the groups in it."""
    order = np.lexsort(rows.T[::-1])
    held = rows[order]
    head = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(1)]))
    number = np.empty(len(rows), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(rows))))
    return number, order, head


class _Cells:
    """Cells of a grid that hold points: their numbers, boxes and points."""

    def __init__(self, x: np.ndarray, side: float):
        at = np.floor(x / side).astype(np.int64)
        self.of, self.order, self.first = _groups(at)
        self.at = at[self.order[self.first]]
        self.count = np.diff(np.append(self.first, len(x)))
        self.lo, self.hi = (f.reduceat(x[self.order], self.first, axis=0) for f in (np.minimum, np.maximum))

    def points(self, cells: np.ndarray) -> np.ndarray:
        return self.order[tiles.spread(self.first[cells], self.count[cells])]


def _chunks(size: np.ndarray):
    """Slices of runs whose sizes sum to about ``PAIRS`` at most."""
    done, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS)))
        yield slice(at, to)
        at = to


def _close(a: np.ndarray, b: np.ndarray, e2: float) -> np.ndarray:
    d2 = 0.0
    for i in range(a.shape[1]):
        d2 = d2 + (a[:, i] - b[:, i]) * (a[:, i] - b[:, i])
    return d2 <= e2


def _touch(x: np.ndarray, cells: _Cells, a: int, b: int, e2: float) -> bool:
    """Whether two cells have points within ε: only points within ε of the other cell's box are compared."""
    p, q = cells.points(np.array([a])), cells.points(np.array([b]))
    p = p[tiles.gap_far(x[p], x[p], cells.lo[[b]], cells.hi[[b]])[0] <= e2]
    q = q[tiles.gap_far(x[q], x[q], cells.lo[[a]], cells.hi[[a]])[0] <= e2]
    if not len(q):
        return False
    step = max(1, PAIRS // len(q))
    return any(_close(np.repeat(x[p[at:at + step]], len(q), axis=0), np.tile(x[q], (len(p[at:at + step]), 1)), e2).any()
               for at in range(0, len(p), step))


def dbscan_group(x: np.ndarray, pos: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Cluster of each row (−1: noise) of the points ``x`` (n × d) at the row positions ``pos``."""
    if not len(x):
        return np.zeros(0, np.int32)
    d, e2 = x.shape[1], eps * eps
    side, link_side = (eps / math.sqrt(n) * (1 - 1e-9) for n in (d, d + 3))
    reach, link_reach = math.floor(eps / side) + 1, math.floor(eps / link_side) + 1
    point, order, head = _groups(x)
    rows_x, x = x, x[order[head]]
    w, first = np.diff(np.append(head, len(rows_x))), np.minimum.reduceat(pos[order], head)

    # core points: whole heavy cells, and light points with enough neighbours
    cells = _Cells(x, side)
    weight = np.bincount(cells.of, weights=w).astype(np.int64)
    heavy, light = np.flatnonzero(weight >= min_samples), np.flatnonzero(weight[cells.of] < min_samples)
    core = weight[cells.of] >= min_samples
    if len(light):
        found, q, c = tiles.count_neighbours(cells.at[heavy], cells.lo[heavy], cells.hi[heavy], weight[heavy], cells.at[cells.of[light]],
                                             x[light], w[light], np.arange(len(light)), reach, eps, min_samples, d)
        c = heavy[c]
        for s in _chunks(cells.count[c]):
            i, j = np.repeat(q[s], cells.count[c[s]]), cells.points(c[s])
            near = _close(x[light[i]], x[j], e2)
            found += np.bincount(i[near], weights=w[j[near]], minlength=len(light)).astype(np.int64)
        core[light] = found >= min_samples
    out = np.full(len(x), -1, np.int64)
    cores = np.flatnonzero(core)
    if not len(cores):
        return out[point].astype(np.int32)

    # clusters: link cells joined by their boxes, the open pairs that are still apart by their points
    cx = x[cores]
    linked = _Cells(cx, link_side)
    label, a, b = tiles.link_cells(linked.at, linked.lo, linked.hi, np.ones(len(linked.at), bool), link_reach, eps, d + 3)
    size = linked.count[a] * linked.count[b]
    few = np.flatnonzero(size <= 4096)
    for s in _chunks(size[few]):
        own = few[s][label[a[few[s]]] != label[b[few[s]]]]
        na, nb = linked.count[a[own]], linked.count[b[own]]
        pair = np.repeat(np.arange(len(own)), na * nb)
        k = tiles.spread(np.zeros(len(own), np.int64), na * nb)
        i = linked.order[linked.first[a[own]][pair] + k // nb[pair]]
        j = linked.order[linked.first[b[own]][pair] + k % nb[pair]]
        met = own[np.unique(pair[_close(cx[i], cx[j], e2)])]
        label = tiles.unite(label, a[met], b[met])
    for i in np.flatnonzero(size > 4096):
        if label[a[i]] != label[b[i]] and _touch(cx, linked, a[i], b[i], e2):
            label = tiles.unite(label, a[[i]], b[[i]])
    least = np.full(len(linked.at), np.iinfo(np.int64).max)
    np.minimum.at(least, label[linked.of], first[cores])
    roots = np.unique(label)
    number = np.empty(len(linked.at), np.int64)
    number[roots[np.argsort(least[roots])]] = np.arange(len(roots))
    cell_cluster = number[label]
    out[cores] = cell_cluster[linked.of]

    # border points: the least cluster that has a core point within ε
    rest = light[~core[light]]
    if len(rest):
        best, q, c = tiles.least_label(linked.at, linked.lo, linked.hi, cell_cluster, np.floor(x[rest] / link_side).astype(np.int64), x[rest],
                                       link_reach, eps, d + 3)
        for s in _chunks(linked.count[c]):
            i, j = np.repeat(q[s], linked.count[c[s]]), linked.points(c[s])
            near = _close(x[rest[i]], cx[j], e2)
            np.minimum.at(best, i[near], cell_cluster[linked.of[j[near]]])
        out[rest] = np.where(best < np.iinfo(np.int64).max, best, -1)
    return out[point].astype(np.int32)

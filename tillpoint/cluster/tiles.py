"""Neighbour search over occupied grid cells, a tile of cells at a time.

A tile is a block of at most ``TILE_CELLS`` cells of the grid, whatever number
of points they hold; it also sees the cells within reach around it. Inside a
tile, each query meets the occupied cells about its own, nearest cells first, and
drops out as soon as its answer is settled (``NearestFirst``). Where a ball has
too many cells for that (many dimensions), occupied cells are listed by coarse
blocks as wide as the reach, and each query meets those of the 3^d blocks about
its own (``Near``): the work grows with the occupied neighbours, not with the
cells there could be.

The functions here run inside one task on one tile's rows, in numpy, a bounded
number of pairs at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_CELLS = 1 << 18
PAIRS = 1 << 20
STEP = 1 << 16  # (query, cell) lookups at a time
MOST_OFFSETS = 20_000
DENSE = 1 << 22  # cells of a box that are looked up in a plain table


def tile_width(d: int, reach: int, cells: int = TILE_CELLS) -> int:
    """Cells a tile has along each dimension."""
    return max(2 * reach, int(cells ** (1 / d) + 1e-9))


def over_tiles(rows: DataFrame, cell: list[str], reach: int, width: int) -> DataFrame:
    """``rows`` once for each tile that sees their cell: ``t0…`` and ``owner`` (the cell is the tile's own).

    A tile lies about the origin, where scaled data do.
    """
    out = rows
    tile = lambda at: F.floor((at + width // 2) / width)
    for i, c in enumerate(cell):
        out = out.withColumn(f"t{i}", F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    own = F.lit(True)
    for i, c in enumerate(cell):
        own &= F.col(f"t{i}") == tile(F.col(c))
    return out.withColumn("owner", own)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (count[0] of them), first[1], …"""
    total = int(count.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)


class Near:
    """Items of occupied cells (n × d cell numbers) by coarse blocks."""

    def __init__(self, cells: np.ndarray, reach: int):
        self.reach = reach
        block = cells // reach
        self.low = block.min(0) if len(cells) else np.zeros(cells.shape[1], np.int64)
        self.extent = (block.max(0) - self.low + 1) if len(cells) else np.zeros(cells.shape[1], np.int64)
        self.stride = np.concatenate([[1], np.cumprod(self.extent[:-1])]).astype(np.int64)
        code = (block - self.low) @ self.stride
        self.order = np.argsort(code, kind="stable")
        self.code, self.first, self.count = np.unique(code[self.order], return_index=True, return_counts=True)

    def meet(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item): every item in the blocks about each query's cell, at most about ``PAIRS`` at a time."""
        if not len(self.code):
            return
        offsets = np.array(list(itertools.product((-1, 0, 1), repeat=cells.shape[1])))
        step = max(1, PAIRS // len(offsets))
        for at in range(0, len(cells), step):
            block = cells[at:at + step] // self.reach - self.low
            query, place = [], []
            for o in offsets:
                t = block + o
                inside = ((t >= 0) & (t < self.extent)).all(1)
                code = t @ self.stride
                pos = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                hit = np.flatnonzero(inside & (self.code[pos] == code))
                query.append(hit)
                place.append(pos[hit])
            query, place = np.concatenate(query), np.concatenate(place)
            done = np.cumsum(self.count[place])
            i = 0
            while i < len(place):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS)))
                n = self.count[place[i:j]]
                yield at + np.repeat(query[i:j], n), self.order[spread(self.first[place[i:j]], n)]
                i = j


@lru_cache(maxsize=16)
def near_offsets(d: int, reach: int, bound: int | None = None) -> np.ndarray | None:
    """Offsets of the cells that can hold a point within ε, nearest first; None if there are too many.

    ``bound``: floor((ε / cell side)²); ``reach``: floor(ε / cell side) + 1.
    """
    if (2 * reach + 1) ** d > MOST_OFFSETS:
        return None
    offsets = np.array(list(itertools.product(range(-reach, reach + 1), repeat=d)), dtype=np.int64)
    gap = (np.maximum(np.abs(offsets) - 1, 0) ** 2).sum(1)
    offsets = offsets[gap <= (reach * reach if bound is None else bound)]
    return offsets[np.argsort((offsets ** 2).sum(1), kind="stable")]


class NearestFirst:
    """Items of occupied cells (n × d cell numbers), met from a query's own cell outwards."""

    def __init__(self, cells: np.ndarray, reach: int, bound: int | None = None):
        self.reach, self.offsets = reach, near_offsets(cells.shape[1], reach, bound)
        self.none = not len(cells)
        if self.none:
            return
        if self.offsets is None:
            self.blocks = Near(cells, reach)
            return
        # the box about the items has a margin, so that no offset leads from one of its edges to another
        self.low = cells.min(0) - 2 * reach
        self.extent = cells.max(0) - self.low + 1 + 2 * reach
        self.stride = np.concatenate([[1], np.cumprod(self.extent[:-1])]).astype(np.int64)
        code = (cells - self.low) @ self.stride
        self.order = np.argsort(code, kind="stable")
        self.code, self.first, self.count = np.unique(code[self.order], return_index=True, return_counts=True)
        self.table = None
        if np.prod(self.extent.astype(float)) <= DENSE:
            self.table = np.full(int(np.prod(self.extent)), -1, np.int32)
            self.table[self.code] = np.arange(len(self.code), dtype=np.int32)

    def _place(self, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[code]
        pos = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[pos] == code, pos, -1)

    def meet(self, cells: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) pairs, at most about ``PAIRS`` at a time, of the queries that are ``open_``.

        The caller may close queries between steps; they meet no further cells.
        """
        if self.none:
            return
        if self.offsets is None:
            left = np.flatnonzero(open_)
            for i, j in self.blocks.meet(cells[left]):
                yield left[i], j
            return
        at = cells - self.low
        left = np.flatnonzero(open_ & ((at >= self.reach) & (at < self.extent - self.reach)).all(1))
        code, shift = at @ self.stride, self.offsets @ self.stride
        o = 0
        while o < len(shift) and len(left):
            step = shift[o:o + max(1, STEP // len(left))]
            o += len(step)
            place = self._place((code[left][None, :] + step[:, None]).ravel())
            hit = np.flatnonzero(place >= 0)
            query, place = left[hit % len(left)], place[hit]
            done = np.cumsum(self.count[place])
            i = 0
            while i < len(place):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS)))
                n = self.count[place[i:j]]
                yield np.repeat(query[i:j], n), self.order[spread(self.first[place[i:j]], n)]
                i = j
            left = left[open_[left]]


def gap_far(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the nearest and the farthest corners of boxes (rows), summed dimension by dimension."""
    gap = far = 0.0
    for i in range(alo.shape[1]):
        g = np.maximum(np.maximum(blo[:, i] - ahi[:, i], alo[:, i] - bhi[:, i]), 0.0)
        f = np.maximum(bhi[:, i] - alo[:, i], ahi[:, i] - blo[:, i])
        gap, far = gap + g * g, far + f * f
    return gap, far


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Set labels (each the least member's number) after a[i] and b[i] join."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def count_neighbours(near_cells: np.ndarray, cell_lo: np.ndarray, cell_hi: np.ndarray, cell_w: np.ndarray, points_cell: np.ndarray,
                     points: np.ndarray, points_w: np.ndarray, own: np.ndarray, reach: int, eps: float, enough: int,
                     bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of the ``own`` points among light points and heavy cells, counted until they are ``enough``.

    Returns (weight found for each own point, and pairs (own point, heavy cell) that straddle its ε-ball while
    the weight found is not ``enough``).
    """
    e2 = eps * eps
    found = np.zeros(len(own), np.int64)
    open_ = np.ones(len(own), bool)
    q, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x, x_cell = points[own], points_cell[own]
    for i, j in NearestFirst(points_cell, reach, bound).meet(x_cell, open_):
        d2, _ = gap_far(x[i], x[i], points[j], points[j])
        close = d2 <= e2
        found += np.bincount(i[close], weights=points_w[j[close]], minlength=len(own)).astype(np.int64)
        open_[i] = found[i] < enough
    for i, j in NearestFirst(near_cells, reach, bound).meet(x_cell, open_):
        gap, far = gap_far(x[i], x[i], cell_lo[j], cell_hi[j])
        whole = far <= e2
        found += np.bincount(i[whole], weights=cell_w[j[whole]], minlength=len(own)).astype(np.int64)
        open_[i] = found[i] < enough
        part = (gap <= e2) & ~whole & open_[i]
        q.append(i[part])
        c.append(j[part])
    q, c = np.concatenate(q), np.concatenate(c)
    left = found[q] < enough
    return found, q[left], c[left]


def link_cells(cells: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, reach: int, eps: float,
               bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core cells of a tile: each one's least linked cell by boxes alone, and the pairs that boxes leave open.

    A pair is linked if the farthest corners are within ε, not linked if the nearest are beyond it; an open pair whose
    cells are linked through others is left out. Pairs of two cells that are both other tiles' own are theirs.
    Cells of the largest set look for no others: whatever is apart from it looks for them.
    """
    e2 = eps * eps
    label = np.arange(len(cells))
    open_ = np.ones(len(cells), bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in NearestFirst(cells, reach, bound).meet(cells, open_):
        apart = (own[i] | own[j]) & (label[i] != label[j])
        i, j = i[apart], j[apart]
        if not len(i):
            continue
        gap, far = gap_far(lo[i], hi[i], lo[j], hi[j])
        sure = far <= e2
        label = unite(label, i[sure], j[sure])
        part = (gap <= e2) & ~sure
        a.append(np.minimum(i, j)[part])
        b.append(np.maximum(i, j)[part])
        open_[:] = label != np.bincount(label).argmax()
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    a, b = pairs
    apart = label[a] != label[b]
    return label, a[apart], b[apart]


def least_label(cells: np.ndarray, lo: np.ndarray, hi: np.ndarray, cell_label: np.ndarray, points_cell: np.ndarray,
                points: np.ndarray, reach: int, eps: float, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least label among cells wholly within ε of each point (the largest integer: none), and the pairs
    (point, cell) that straddle and could give a lower one."""
    e2 = eps * eps
    best = np.full(len(points), np.iinfo(np.int64).max)
    q, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in NearestFirst(cells, reach, bound).meet(points_cell, np.ones(len(points), bool)):
        lower = cell_label[j] < best[i]
        i, j = i[lower], j[lower]
        gap, far = gap_far(points[i], points[i], lo[j], hi[j])
        whole = far <= e2
        np.minimum.at(best, i[whole], cell_label[j[whole]])
        part = (gap <= e2) & ~whole
        q.append(i[part])
        c.append(j[part])
    q, c = np.concatenate(q), np.concatenate(c)
    lower = cell_label[c] < best[q]
    return best, q[lower], c[lower]

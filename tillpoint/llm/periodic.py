"""Periodic runs of words, found by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)``
words long, that no neighbouring word extends. Its *region*, the positions i
of the stretch whose word equals word i + q, is ``max(6, 4 q) - q`` words long
at least, so it holds a point of the grid 0, g, 2 g, ... of that step. Hence
for each period q the grid points are tried: the harmonic sum of their numbers
is about ``n log n`` for n words. A point whose word and neighbours do not
recur q words on is passed over; the others are extended both ways.

Extensions are answered in constant time. Only suffixes that start at
positions whose remainder (mod 31) lies in a difference cover are sorted, by
prefix doubling over blocks of 31 words; neighbours' common prefixes go into a
sparse table of range minima. Two positions are compared word by word for the
fewer than 31 steps until both reach sampled positions, then the table has the
rest. Leftward extensions use the same structure of the reversed words.

A run of period k q with the extent of a run of period q is the same stretch
(by the periodicity lemma), so the least period per extent is kept.

Many documents share one structure, with a word between them that occurs
nowhere else; a long document stands alone. The work is one map over the
documents, with no shuffle. Words are ``[^\\x20\\x09-\\x0D]+``, told apart by
64-bit hashes; where hashes decide about a run, equal ones are checked byte by byte.

Null, empty and blank texts have no words, no runs and an empty collapsed
text. Repeated rows give equal rows. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm import text as T

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: A perfect difference set: each remainder but 0 is one difference of two members.
COVER, MEMBERS = 31, (0, 1, 3, 8, 12, 18)
POINTS = 1 << 20  # grid points, or bytes copied, at a time
LONG_WORD = 1 << 16


def _first_members() -> np.ndarray:
    out = np.zeros(COVER, np.int64)
    for a in MEMBERS:
        for b in MEMBERS:
            out[(b - a) % COVER] = a
    return out


_FIRST = _first_members()
_CLASS = np.full(COVER, -1, np.int64)
_CLASS[list(MEMBERS)] = range(len(MEMBERS))


class Extensions:
    """Longest common prefixes of suffixes of ``words``, whose last value occurs nowhere else (values from 1)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(COVER, words.dtype)])
        counts = [max(0, -(-(n - r) // COVER)) for r in MEMBERS]
        self.base = np.cumsum([0, *counts])[:-1]
        at = np.concatenate([np.arange(c) * COVER + r for r, c in zip(MEMBERS, counts)])
        levels = self._sort(at)
        self.rank = levels[-1]
        self.minima = self._minima(at, levels)

    def _sample(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the sampled suffixes that start at ``at``."""
        return self.base[_CLASS[at % COVER]] + at // COVER

    def _sort(self, at: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 31, 62, 124, ... words, until none are equal.

        A rank is the place of the first suffix of an equal group; only groups of two and more are sorted again.
        """
        rank = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))

        def refine(open_, by):
            order = np.argsort((rank[open_] << 32) | by, kind="stable")
            s, by = open_[order], by[order]
            old = rank[s]
            head = np.ones(len(s), bool)
            head[1:] = old[1:] != old[:-1]
            part = head.copy()
            part[1:] |= by[1:] != by[:-1]
            place = np.arange(len(s))
            rank[s] = old + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
            alone = part.copy()
            alone[:-1] &= part[1:]
            return s[~alone]

        for t in range(COVER):
            if not len(open_):
                break
            open_ = refine(open_, self.words[at[open_] + t].astype(np.int64))
        levels, length = [rank.copy()], COVER
        while len(open_):
            open_ = refine(open_, rank[self._sample(at[open_] + length)])
            levels.append(rank.copy())
            length *= 2
        return levels

    def _minima(self, at: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(levels[-1])
        i, j = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(i), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][self._sample(i)] == levels[level][self._sample(j)]
            for x in (i, j, common):
                x[same] += COVER << level
        common += self._direct(i, j, np.full(len(i), COVER))
        table = [common.astype(np.int32)]
        while 2 ** len(table) <= len(common):
            half, last = 2 ** (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``."""
        out = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for t in range(COVER):
            alive = alive[most[alive] > t]
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            if not len(alive):
                break
            out[alive] += 1
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j (i != j)."""
        to_sample = (_FIRST[(j - i) % COVER] - i) % COVER
        out = self._direct(i, j, to_sample)
        rest = np.flatnonzero(out == to_sample)
        a = self.rank[self._sample(i[rest] + to_sample[rest])]
        b = self.rank[self._sample(j[rest] + to_sample[rest])]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(rest), np.int64)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        out[rest] += found
        return out


def _grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position in it, period) of all grid points, about ``POINTS`` at a time."""
    most = np.where(lengths >= LEAST_LENGTH, lengths // LEAST_PERIODS, 0)
    doc = np.repeat(np.arange(len(lengths)), most)
    period = T.ranges(np.ones(len(lengths), np.int64), most)
    step = np.maximum(LEAST_LENGTH, LEAST_PERIODS * period) - period
    count = -(-(lengths[doc] - period) // step)
    done = np.cumsum(count)
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + POINTS)))
        c = count[at:end]
        k = T.ranges(np.zeros(len(c), np.int64), c)
        yield np.repeat(doc[at:end], c), k * np.repeat(step[at:end], c), np.repeat(period[at:end], c)
        at = end


def _candidates(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points that recur one period on, with two neighbours in a row: all points inside regions are among them."""
    lengths = np.diff(first)
    found = []
    for doc, i, p in _grid(lengths):
        n, base = lengths[doc], first[doc]
        hit = np.flatnonzero(ids[base + i] == ids[base + i + p])
        doc, i, p, n, base = (x[hit] for x in (doc, i, p, n, base))

        def same(d):
            k = i + d
            inside = (k >= 0) & (k + p < n)
            k = np.where(inside, k, 0)
            return inside & (ids[base + k] == ids[base + np.where(inside, k + p, 0)])

        left, right = same(-1), same(1)
        near = (left & right) | (right & same(2)) | (left & same(-2))
        found.append((doc[near], i[near], p[near]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def find(ids: np.ndarray, first: np.ndarray, exact=lambda words: None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``ids[first[t]:first[t + 1]]`` are the words of text t. ``exact(words)``, given the word numbers of the texts that
    may hold a run, returns ids from 1 that tell them apart beyond doubt (None: the given ids do).
    """
    doc, i, p = _candidates(ids, first)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    used, doc = np.unique(doc, return_inverse=True)
    lengths = np.diff(first)[used]
    words = T.ranges(first[used], lengths)
    known = exact(words)
    if known is None:
        known = np.unique(ids[words], return_inverse=True)[1] + 1
    top = int(known.max())
    base = np.cumsum(lengths) - lengths + np.arange(len(used)) + 1  # a separator before each text, and one at the end
    row = np.empty(len(words) + len(used) + 1, np.int64)
    row[np.append(base, len(row)) - 1] = top + 1 + np.arange(len(used) + 1)
    row[T.ranges(base, lengths)] = known
    x = base[doc] + i
    right = Extensions(row).common(x, x + p)
    last = len(row) - 1
    left = Extensions(row[::-1].copy()).common(last - (x - 1), last - (x + p - 1))
    long = (left + right) >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * p) - p
    doc, start, length, p = doc[long], (i - left)[long], (left + right + p)[long], p[long]
    order = np.lexsort((p, length, start, doc))
    doc, start, length, p = doc[order], start[order], length[order], p[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, p = used[doc[new]], start[new], length[new], p[new]
    order = np.lexsort((p, start, doc))
    return doc[order], start[order], length[order], p[order]


def dropped(n: int, first: np.ndarray, runs: tuple) -> np.ndarray:
    """Which of the n words some run holds after its first period."""
    doc, start, length, period = runs
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first[doc] + start + period, 1)
    np.add.at(edge, first[doc] + start + length, -1)
    return np.cumsum(edge[:-1]) > 0


class Words:
    """Spans and hashes of the words of some texts, in memory bounded by a few times their bytes."""

    def __init__(self, hasher: T.SpanHasher):
        self.hasher = hasher

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start, end = T.runs(data, offsets, T.NON_SPACE)
        hashes = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            if end[at] - start[at] > LONG_WORD:
                hashes[at] = xxhash.xxh64_intdigest(data[start[at]:end[at]].tobytes())
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(end, start[at] + T.SLICE_BYTES, side="right")))
            long = np.flatnonzero(end[at:stop] - start[at:stop] > LONG_WORD)
            stop = at + int(long[0]) if len(long) else stop
            low = start[at]
            hashes[at:stop] = self.hasher.hash(data[low:end[stop - 1]], start[at:stop] - low, end[at:stop] - low)
            at = stop
        return start, end, hashes, np.searchsorted(start, offsets)


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Ids from 1 of words by their bytes: by hash, with each word compared with the first of its hash."""
    _, example, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    same = bool((size == size[example][ids]).all())
    at = 0
    done = np.cumsum(size)
    while same and at < len(size):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + POINTS)))
        n = size[at:stop]
        same = bool((data[T.ranges(start[at:stop], n)] == data[T.ranges(start[example][ids[at:stop]], n)]).all())
        at = stop
    if same:
        return ids + 1
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(data[a:b].tobytes(), len(numbers) + 1) for a, b in zip(start, end)], np.int64)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts, joined by one space; ``doc`` is each word's text, in order."""
    size = end - start
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    done = np.cumsum(size + ~first)
    out = np.full(int(done[-1]) if len(done) else 0, 32, np.uint8)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + POINTS)))
        s = size[at:stop]
        out[T.ranges(done[at:stop] - s, s)] = data[T.ranges(start[at:stop], s)]
        at = stop
    ends = np.concatenate([[0], done])[np.searchsorted(doc, np.arange(n + 1))]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _slice(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[pa.Array]:
    """n_words, runs, collapsed of some texts."""
    n = len(offsets) - 1
    start, end, hashes, first = words.of(data, offsets)
    runs = find(hashes, first, lambda w: exact_ids(data, start[w], end[w], hashes[w]))
    kept = np.flatnonzero(~dropped(len(start), first, runs))
    doc = np.searchsorted(first, kept, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs[1:]], fields=list(RUN))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[0], np.arange(n + 1)).astype(np.int32)), spans)
    return [pa.array(np.diff(first), pa.int64()), listed, joined(data, start[kept], end[kept], doc, n)]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: all runs (start, length, period; by start, then period) and
    the words that no run holds after its first period, joined by one space."""

    def run(batches):
        words = Words(T.SpanHasher())
        for batch in batches:
            data, offsets = T.texts(batch.column(1))
            for i, j in T.slices(offsets):
                part = data[offsets[i]:offsets[j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *_slice(part, offsets[i:j + 1] - offsets[i], words)],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: str):
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    ordered = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"),
                                                          r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ordered)

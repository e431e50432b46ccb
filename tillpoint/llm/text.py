"""Vectorised byte scanning shared by the text operators.

A batch of UTF-8 texts is one byte array plus document offsets. Spans (words,
token segments) are found with byte classes and hashed all at once: with
prefix sums of ``T[b_i] * B**i`` (mod 2**64) the hash of any span is one
subtraction and one multiplication. Every class used here treats bytes of
0x80 and more alike, so byte spans are code point spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible mod 2**64
_SEED = 20240229


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()

#: Word bytes once A-Z are lower-cased: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Everything but space and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents [i, j) of about ``most`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Spans:
    """Spans of one slice: byte starts and ends, hashes, and each document's first span."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # doc[i]:doc[i+1] are document i's spans


class SpanHasher:
    """Hashes byte spans; the power tables grow to the longest slice seen."""

    def __init__(self, lower: bool = False):
        table = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
        self.table = table[LOWER] if lower else table
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n <= len(self.power):
            return
        n = max(n, SLICE_BYTES)
        self.power, self.inverse = (np.full(n, np.uint64(b)) for b in (int(_BASE), pow(int(_BASE), -1, 2**64)))
        self.power[0] = self.inverse[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.inverse, out=self.inverse)

    def hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        values = self.table[data]
        values *= self.power[:n]
        np.cumsum(values, out=sums[1:])
        out = sums[end]
        out -= sums[start]
        out *= self.inverse[start]
        return out

    def of(self, words: bytes) -> int:
        a = np.frombuffer(words, np.uint8)
        return int(self.hash(a, np.array([0]), np.array([len(a)]))[0])


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes; no run crosses a document's edge."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, hasher: SpanHasher) -> Spans:
    start, end = runs(data, offsets, member)
    return Spans(start, end, hasher.hash(data, start, end) if len(start) else np.zeros(0, np.uint64),
                 np.searchsorted(start, offsets))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … (count[0] of them), start[1], …"""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - before, count)

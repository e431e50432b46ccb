"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` words (an item of fewer
words is one window). The alphabet is words, a block is up to three of them:

* SHIFT gives for the block that ends at the cursor how far the cursor may
  jump without missing an occurrence; unknown blocks jump ``m - B + 1`` words;
* a zero shift selects, by the hash of that suffix block, the bucket of
  patterns that end so; PREFIX blocks thin the bucket;
* a direct comparison of the words' bytes confirms each occurrence.

Patterns of one length make one table set (the shift depends on it). Cursors
of many text runs step together in numpy. The benchmark is cut into blocks of
about ``block_bytes`` of text by item hash; the tables of each block are one
broadcast of bounded size, read by every task. A benchmark is a stated query
set: a larger one only adds blocks, which every slice of text passes in turn.

Nulls and texts without a word have no words and no hits; items without id,
text or words are ignored; repeated rows each give their own row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.text import ALNUM, LOWER, SpanHasher, Spans, ranges, slices, spans, texts

WINDOW = 10
BLOCK_WORDS = 3
BLOCK_BYTES = 2 << 20
RUN = 512  # positions a cursor owns
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean, item_ids array<long>")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text."""
    return _WORD.findall(text.encode().lower()) if text else []


def _block_key(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Key of the block of ``size`` words whose last word is at ``end``."""
    key = hashes[end] * _MIX[0]
    for k in range(1, size):
        key = (key ^ (key >> np.uint64(29))) + hashes[end - k] * _MIX[k % 3]
    return key * _MIX[1]


class PatternSet:
    """Wu-Manber tables for patterns of ``m`` words each."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], hasher: SpanHasher):
        self.words = list(patterns)
        self.items = [sorted(patterns[p]) for p in self.words]
        self.m = m = len(self.words[0])
        self.block = b = min(BLOCK_WORDS, m)
        vocabulary = {w: hasher.of(w) for p in self.words for w in p}
        h = np.array([vocabulary[w] for p in self.words for w in p], np.uint64)
        first = np.arange(len(self.words)) * m
        self.bits = max(12, int(np.ceil(np.log2(max(2, len(self.words) * m)))) + 4)
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint16 if m < 65_000 else np.uint32)
        for j in range(b - 1, m):  # block ending at word j of the pattern
            np.minimum.at(self.shift, self._slot(_block_key(h, first + j, b)), m - 1 - j)
        suffix = _block_key(h, first + m - 1, b)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order
        self.prefix = _block_key(h, first + b - 1, b)[order]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, low: np.ndarray, sp: Spans) -> tuple[np.ndarray, np.ndarray]:
        """(position of an occurrence's first word, pattern) of every occurrence."""
        m, b, h = self.m, self.block, sp.hash
        lo, hi = sp.doc[:-1] + m - 1, sp.doc[1:]  # window ends of each document
        lo, hi = lo[lo < hi], hi[lo < hi]
        parts = -(-(hi - lo) // RUN)
        pos = ranges(np.zeros(len(lo), np.int64), parts) * RUN + np.repeat(lo, parts)
        stop = np.minimum(pos + RUN, np.repeat(hi, parts))
        found_at, found = [], []
        while len(pos):
            key = _block_key(h, pos, b)
            step = self.shift[self._slot(key)].astype(np.int64)
            zero = step == 0
            if zero.any():
                at, of = self._confirm(low, sp, pos[zero], key[zero])
                found_at.append(at)
                found.append(of)
                step[zero] = 1
            pos = pos + step
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def _confirm(self, low: np.ndarray, sp: Spans, pos: np.ndarray, key: np.ndarray):
        left = np.searchsorted(self.suffix, key, side="left")
        count = np.searchsorted(self.suffix, key, side="right") - left
        at, entry = np.repeat(pos, count), ranges(left, count)
        first = at - self.m + 1
        same = _block_key(sp.hash, first + self.block - 1, self.block) == self.prefix[entry]
        first, entry = first[same], self.order[entry[same]]
        keep = np.zeros(len(first), bool)
        for k, (w, p) in enumerate(zip(first.tolist(), entry.tolist())):
            keep[k] = all(low[sp.start[w + i]:sp.end[w + i]].tobytes() == x
                          for i, x in enumerate(self.words[p]))
        return first[keep], entry[keep]


def build(items: list[tuple[int, str]], window: int = WINDOW) -> list[PatternSet]:
    """Pattern sets, one for each pattern length, of (item_id, text) rows."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        m = min(window, len(w))
        for i in range(len(w) - m + 1):
            by_length.setdefault(m, {}).setdefault(tuple(w[i:i + m]), set()).add(int(item))
    hasher = SpanHasher(lower=True)
    return [PatternSet(p, hasher) for _, p in sorted(by_length.items())]


def _mark(low: np.ndarray, sp: Spans, sets: list[PatternSet], edges: np.ndarray, items: list[set[int]]) -> None:
    """Add to ``edges`` (+1 at an occurrence's first word, -1 behind its last) and to each document's items."""
    for ps in sets:
        at, of = ps.search(low, sp)
        if len(at):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + ps.m, -1)
            for d, p in zip((np.searchsorted(sp.doc, at, side="right") - 1).tolist(), of.tolist()):
                items[d].update(ps.items[p])


def scan(text: pa.Array, blocks: list[list[PatternSet]], hasher: SpanHasher) -> Iterator[tuple[int, int, list[int]]]:
    """(n_words, n_hit, items) for each text."""
    data, offsets = texts(text)
    for i, j in slices(offsets):
        off = offsets[i:j + 1] - offsets[i]
        low = LOWER[data[offsets[i]:offsets[j]]]
        sp = spans(low, off, ALNUM, hasher)
        edges, items = np.zeros(len(sp.start) + 1, np.int32), [set() for _ in range(j - i)]
        for sets in blocks:
            _mark(low, sp, sets, edges, items)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
        for k in range(j - i):
            a, b = sp.doc[k], sp.doc[k + 1]
            yield int(b - a), int(hit[b] - hit[a]), sorted(items[k])


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast tables of the benchmark, in blocks of about ``block_bytes`` of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], window)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside any benchmark window, the items found.

    Map-only over ``docs``. No documents give no rows; no items give no hits.
    """
    broadcasts = pattern_blocks(benchmark, window, block_bytes)

    def run(batches):
        hasher = SpanHasher(lower=True)
        for batch in batches:
            rows = list(scan(batch.column(1), [b.value for b in broadcasts], hasher))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([digest(r[2]) for r in rows], pa.string()),
                pa.array([r[1] > 0 for r in rows], pa.bool_()),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(run, SCHEMA)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; the columns stay as they are.

    The verdict is taken row by row in the same pass, so nothing is joined back.
    """
    broadcasts = pattern_blocks(benchmark, window, block_bytes)
    place = docs.columns.index(text_col)

    def run(batches):
        hasher = SpanHasher(lower=True)
        for batch in batches:
            clean = [hit == 0 for _, hit, _ in scan(batch.column(place), [b.value for b in broadcasts], hasher)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

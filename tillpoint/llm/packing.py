"""Best-fit packing: hierarchical residual packing of token sequences.

1. Each partition tokenizes its documents, cuts only those longer than
   ``capacity`` and packs its pieces best-fit (largest first, the fullest bin
   that still takes the piece).
2. Bins within ``slack`` tokens of full are emitted. Underfull bins become
   items of their fill and are dealt to fewer tasks, which pack them
   best-fit again, and so on up the tree until one task's share is left or
   a round empties less than 1 % of its bins. A task's share is bounded by
   ``share`` bins: with more bins left a round has more tasks.

Rounds move only (bin, root, shift, fill) numbers; pieces learn their place at
the end by one join on the bin.

Null and empty texts are one piece of one token (id 2). Repeated rows are
packed each on their own. No documents give no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored
from tillpoint.llm.text import NON_SPACE, SpanHasher, ranges, slices, texts

CAPACITY = 1024
END_ID = 2
SLACK = 8
SHARE = 200_000
FAN_IN = 8
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

# Fixed value: the byte-level BPE's split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPECIAL = b"<|endoftext|>"
_PLAIN = re.compile(r" ?[!-~¡-ſ]+")
_KNOWN_MOST = 1_500_000

_ASCII_ALNUM = np.zeros(256, bool)
_ASCII_ALNUM[48:58] = _ASCII_ALNUM[65:91] = _ASCII_ALNUM[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
#: Bytes that may begin white space other than space and 0x09-0x0D.
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = True
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -     　]")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file of the host."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of many texts, each distinct segment of text encoded once.

    Segments are cut only where the vocabulary's split pattern always cuts:
    before white space that follows other characters, behind a lone line feed,
    and between an ASCII letter or digit and ASCII punctuation. So a text's ids are its segments'
    ids in order. Texts with other white space or a special token's string
    are encoded whole. Segments are known by a 64-bit hash.

    ``tiktoken`` with the same vocabulary encodes segments of plain characters
    (tests hold it against ``tokenizers``), ``tokenizers`` all others.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("segments", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.line_feed = self.whole("\n")[0]
        self.hasher = SpanHasher()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _segment_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment). Plain ones are joined by line feeds, each a token of its own there."""
        is_plain = np.fromiter((_PLAIN.fullmatch(x) is not None for x in segments), bool, len(segments))
        plain = list(compress(segments, is_plain))
        other = [self.whole(x) for x in compress(segments, ~is_plain)]
        joined = np.array(self.fast.encode_ordinary("\n".join(plain)) if plain else [], np.uint32)
        feeds = np.flatnonzero(joined == self.line_feed)
        count = np.zeros(len(segments), np.int64)
        count[~is_plain] = [len(x) for x in other]
        if plain:
            count[is_plain] = np.diff(feeds, prepend=-1, append=len(joined)) - 1
        ids = np.zeros(int(count.sum()), np.uint32)
        of_plain = np.repeat(is_plain, count)
        ids[of_plain] = joined[joined != self.line_feed]
        ids[~of_plain] = [y for x in other for y in x]
        return ids, count

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut points that tile ``data``, and each document's first segment."""
        n = len(data)
        space = ~NON_SPACE[data]
        cut = np.zeros(n, bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (_PUNCT[data[1:]] & _ASCII_ALNUM[data[:-1]])
        feed = np.flatnonzero(data[1:-1] == 10) + 1  # between characters of words, a line feed is a token of its own
        lone = feed[~space[feed - 1] & ~space[feed + 1]]
        cut[lone + 1] = True
        cut[offsets[offsets < n]] = True
        cuts = np.flatnonzero(cut)
        return cuts, np.searchsorted(cuts, offsets)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.known) + len(keys) > _KNOWN_MOST:
            self._forget()
        raw = data.tobytes()
        ids, count = self._segment_ids([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())])
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at, self.count = np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, document offsets into them) of one slice."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, doc = self._segments(data, offsets)
        end = np.append(start[1:], len(data))
        hashes = self.hasher.hash(data, start, end)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != keys[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > _KNOWN_MOST:
                self._forget()
                new[:] = True
            self._learn(data, keys[new], start[index[new]], end[index[new]])
            slot = np.searchsorted(self.known, keys)
        entry = slot[inverse]
        count = self.count[entry]
        ids = self.ids[ranges(self.at[entry], count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[doc]

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, without an end id."""
        data, offsets = texts(column)
        for i, j in slices(offsets):
            part, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            apart = set()
            odd = np.flatnonzero(_ODD[part])
            raw = None
            if len(odd):
                raw = part.tobytes()
                for k in np.unique(np.searchsorted(off, odd, side="right") - 1).tolist():
                    if _ODD_SPACE.search(raw[off[k]:off[k + 1]].decode()):
                        apart.add(k)
            if _SPECIAL[0] in part and _SPECIAL in (raw := raw or part.tobytes()):
                apart.update(k for k in range(j - i) if _SPECIAL in raw[off[k]:off[k + 1]])
            ids, at = self.slice(part, off)
            for k in range(j - i):
                if k in apart:
                    yield np.array(self.whole(raw[off[k]:off[k + 1]].decode()), np.uint32)
                else:
                    yield ids[at[k]:at[k + 1]]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, ranks: str) -> Encoder:
    """This process's encoder: its known segments serve all of a worker's tasks."""
    key = (vocabulary, ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, ranks)
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole pieces behind a first one that may be shorter."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and each bin's fill; largest items first, into the fullest bin that takes it.

    Open bins are listed by their residual; a bit set names the residuals in use.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = used >> s
        if fits:
            residual = s + (fits & -fits).bit_length() - 1
            b = open_at[residual].pop()
            if not open_at[residual]:
                used &= ~(1 << residual)
        else:
            b, residual = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if residual > s:
            open_at[residual - s].append(b)
            used |= 1 << (residual - s)
    return bins, offsets, np.array(fill, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents, each in a bin of its own partition."""
    vocabulary, ranks = vocabulary or tokenizer_path(VOCABULARY), ranks or tokenizer_path(RANKS)

    def run(batches):
        from pyspark import TaskContext

        enc, end = encoder(vocabulary, ranks), np.array([end_id], "<u4").tobytes()
        doc, rows = [], []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1))):
                raw = ids.astype("<u4").tobytes() + end
                for k, (s, m) in enumerate(cut(len(ids) + 1, capacity)):
                    doc.append(doc_id)
                    rows.append((k, s, m, zlib.crc32(raw[4 * s:4 * (s + m)])))
        if not rows:
            return
        a = np.array(rows, np.int64)
        bins, offsets, fill = best_fit(a[:, 2], capacity)
        base = TaskContext.get().partitionId() << 36
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(a[:, 0].astype(np.int32)), pa.array(a[:, 1]), pa.array(a[:, 2]),
             pa.array(a[:, 3]), pa.array(bins + base), pa.array(offsets), pa.array(fill[bins])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(run, PIECES)


MEMBERS = "bin long, root long, shift long, fill long"


def merge_round(members: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """Best-fit the root bins dealt to each task; members follow their root."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        m = {c: table.column(c).to_numpy() for c in ("bin", "root", "shift", "fill")}
        roots, first, member = np.unique(m["root"], return_index=True, return_inverse=True)
        bins, offsets, fill = best_fit(m["fill"][first], capacity)
        head = np.zeros(len(fill), np.int64)  # the root that names each new bin: the one at its start
        head[bins[offsets == 0]] = roots[offsets == 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(m["bin"]), pa.array(head[bins[member]]), pa.array(m["shift"] + offsets[member]),
             pa.array(fill[bins[member]])], names=["bin", "root", "shift", "fill"])

    return members.repartition(tasks, "root").mapInArrow(run, MEMBERS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, slack: int = SLACK, share: int = SHARE, fan_in: int = FAN_IN,
         vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece with the sequence it is packed into and its offset there."""
    local = stored(pieces(docs, id_col, text_col, capacity, end_id, vocabulary, ranks), "packing-pieces")
    under = (local.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.first("fill").alias("fill"))
                  .select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill"))
    open_bins = stored(under, "packing-open")
    left, tasks, done = open_bins.count(), local.select(F.shiftright("bin", 36)).distinct().count() * fan_in, []
    while left > 1:
        tasks = max(1, -(-left // share), tasks // fan_in)
        packed = stored(merge_round(open_bins, tasks, capacity), "packing-round")
        done.append(packed.where(F.col("fill") >= capacity - slack))
        open_bins = packed.where(F.col("fill") < capacity - slack)
        before, left = left, open_bins.select("root").distinct().count()
        if tasks == 1 or (tasks <= -(-left // share) and left > 0.99 * before):
            break
    placed = open_bins
    for part in done:
        placed = placed.unionByName(part)
    return (local.join(placed.select("bin", "root", "shift"), "bin", "left")
                 .select("doc_id", "piece", "start", "length", "ids_crc32",
                         F.coalesce("root", "bin").alias("sequence_id"),
                         (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))

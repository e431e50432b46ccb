"""Substring deduplication by content-defined chunking.

A gear rolling hash (the last 32 bytes; ``h = (h << 1) + G[byte]`` mod 2**32)
cuts a text where its highest ``mask_bits`` bits are zero, no earlier than
``least`` and no later than ``most`` bytes into a chunk, and never inside a
character. Cuts depend on content, so text that is inserted or removed shifts
no chunk but the ones it touches. Chunks are known by a 128-bit digest. Of
equal chunks the first (by input row, then place) stays and the others go,
where neighbouring repeated chunks make a run of ``min_run`` characters or
more; shorter matches, such as one stock phrase, are left alone. With
``whole_texts`` a run that covers its whole text counts whatever its length, so
short copies go too.

The gear hash of all places is a doubling sum in numpy. Chunk rows are narrow
(digest, doc_id, place) and written once; digests that occur once are dropped
by the aggregation's partial sums, and only the rest is joined back, where
a hot digest's rows can be split (the digest side has one row a digest).

Null and empty texts have no chunks and nothing removed. Rows are told apart by
their place in the input (``row``), so repeated rows and ids are texts of their
own: the first stays whole. Spans are code points.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored
from tillpoint.llm.text import ranges, slices, texts

MASK_BITS = 5
LEAST = 16
MOST = 512
MIN_RUN = 100
_GEAR = np.random.Generator(np.random.PCG64(32)).integers(0, 2**32 - 1, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: the sum of G[b_(i-j)] << j over the last 32 bytes."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(data: np.ndarray, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    places = np.flatnonzero(gear(data) >> np.uint32(32 - mask_bits) == 0) + 1
    # moved to the next character's start
    inside = (data & 0xC0) == 0x80
    out, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > most:
            at += most
            while at < n and inside[at]:
                at += 1
            out.append(at)
        if p - at >= least:
            while p < n and inside[p]:
                p += 1
            at = p
            out.append(at)
    if not out or out[-1] < n:
        out.append(n)
    return out


CHUNKS = "row long, idx int, start int, end int, d1 long, d2 long"


def _batch(rows: list[int], ids: list, data: np.ndarray, offsets: np.ndarray, i: int, j: int, mask_bits: int,
           least: int, most: int) -> pa.RecordBatch:
    """Chunk rows of the texts i..j-1, each text led by a head: index -1, number of chunks, of characters, doc_id."""
    at, count, starts, ends, digests = [], [], [], [], []
    for k in range(i, j):
        part = data[offsets[k]:offsets[k + 1]]
        cut = cuts(part, mask_bits, least, most)
        raw, edge = part.tobytes(), [0, *cut]
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[edge]
        count.append(len(cut))
        starts.append(np.concatenate([[len(cut)], chars[:-1]]))
        ends.append(np.concatenate([[chars[-1]], chars[1:]]))
        digests.append((ids[k] or 0).to_bytes(8, "little", signed=True) + (ids[k] is None).to_bytes(8, "little"))
        digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(edge, cut)]
    n = np.array(count, np.int64) + 1
    d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(rows[i:j], n)), pa.array((ranges(np.zeros(len(n), np.int64), n) - 1).astype(np.int32)),
         pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32)),
         pa.array(d[:, 0]), pa.array(d[:, 1])], names=["row", "idx", "start", "end", "d1", "d2"])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = MASK_BITS,
           least: int = LEAST, most: int = MOST) -> DataFrame:
    """The chunks of all texts with their digests, and a head row (``idx`` -1) of every text."""

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(offsets):
                yield _batch(rows, ids, data, offsets, i, j, mask_bits, least, most)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(run, CHUNKS)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = MASK_BITS,
          least: int = LEAST, most: int = MOST, min_run: int = MIN_RUN, whole_texts: bool = False) -> DataFrame:
    """One row per document: its chunks, those in shared runs, those removed, and the removed spans
    (``start:end`` of merged neighbours, comma-joined)."""
    every = stored(chunks(docs, id_col, text_col, mask_bits, least, most), "chunk-digests")
    body, place = every.where("idx >= 0"), F.struct("row", "idx")
    shared = (body.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                  .where("n > 1").select("d1", "d2", "first"))
    again = body.join(shared, ["d1", "d2"]).select("row", "idx", "start", "end", (place != F.col("first")).alias("gone"))
    # neighbours share idx minus their rank among the text's shared chunks
    in_text = Window.partitionBy("row").orderBy("idx")
    if whole_texts:  # a short text's head stands before its first chunk, in the same run, and tells its length
        again = again.unionByName(every.where((F.col("idx") == -1) & F.col("end").between(1, min_run - 1))
                                       .select("row", "idx", "start", "end", F.lit(False).alias("gone")))
    in_run, chunk = Window.partitionBy("row", "run"), F.col("idx") >= 0
    runs = (again.withColumn("run", F.col("idx") - F.row_number().over(in_text))
                 .withColumn("run_chars", F.sum(F.when(chunk, F.col("end") - F.col("start"))).over(in_run))
                 .withColumn("text_chars", F.max(F.when(~chunk, F.col("end"))).over(in_run))
                 .where(chunk & ((F.col("run_chars") >= min_run) | F.coalesce(F.col("run_chars") == F.col("text_chars"), F.lit(False)))))
    gone_islands = (runs.withColumn("island", F.when(F.col("gone"), F.col("idx") - F.sum(F.col("gone").cast("int")).over(in_text)))
                        .groupBy("row", "gone", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"),
                                                              F.max("end").alias("end")))
    per_doc = gone_islands.groupBy("row").agg(
        F.sum("n").alias("n_shared"), F.sum(F.when(F.col("gone"), F.col("n"))).alias("n_removed"),
        F.sum(F.when(F.col("gone"), F.col("end") - F.col("start"))).alias("removed_chars"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("start", "end")))).alias("spans"))
    none = F.lit(0).cast("long")
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return every.where("idx = -1").join(per_doc, "row", "left").select(
        F.when(F.col("d2") == 0, F.col("d1")).alias("doc_id"), F.col("end").cast("long").alias("n_chars"),
        F.col("start").cast("long").alias("n_chunks"), F.coalesce("n_shared", none).alias("n_shared_chunks"),
        F.coalesce("n_removed", none).alias("n_removed_chunks"), F.coalesce("removed_chars", none).alias("removed_chars"),
        F.col("n_shared").isNotNull().alias("has_repeats"), F.coalesce(F.array_join(spans, ","), F.lit("")).alias("removed_spans"),
        "row")


def remove_spans(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of their texts; ``found`` is ``dedup``'s result on the same frame."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index(text_col)])
    numbered = docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id())
    spans = found.where("removed_spans != ''").select(F.col("row").alias("_row"), F.col("removed_spans").alias("_gone"))
    parts = F.concat(F.array(F.lit("0:0")), F.split("_gone", ","))
    edge = lambda s, i: F.split(s, ":")[i].cast("int")
    kept = F.transform(parts, lambda s, i: F.substring(
        text, edge(s, 1) + 1, F.coalesce(edge(F.get(parts, i + 1), 0), F.length(text)) - edge(s, 1)))
    new = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, ""))
    return (numbered.join(spans, "_row", "left")
                    .select(*(new.alias(n) if c == text_col else F.col(n) for n, c in zip(names, docs.columns)))
                    .toDF(*docs.columns))

"""Mixing sources to target weights, with DataFrame and SQL functions only.

The words of a source's documents, one document after the other, are packed
into blocks of ``block`` words (the last one may be shorter). The mixture is a
row of slots, each of which takes one block, in output shards of equal length.

* Targets: sources, by code point and null last, weigh 1, 2, 3, 1, ... and
  share all words by weight. A target stops at ``most`` times its source's
  size; what is over goes to the others by weight, until none is above.
* Quotas: a source's target in slots, never above ``most`` times its blocks.
* Draws: in the first half of the shards every slot draws its source by
  weight, so a shard's counts of the sources are multinomial. A source's draws
  count up to its quota.
* Settling: the slots that are left go to what is left of the quotas, in
  pseudorandom order (multinomial counts given their totals), so that each
  source ends at its quota exactly.
* The t-th slot of a source takes block ``p(t mod n)`` of its n, where p is a
  pseudorandom permutation of 0 .. n-1, another one for each round through the
  source: a swap-or-not shuffle (Hoang, Morris, Rogaway 2012), which needs no
  table and maps any n onto itself. No block is taken more than ``most`` times.
* Slots and blocks are joined by (source, block).

Nothing depends on partitions or time: all choices are hashes of names and
numbers, so reruns agree. Documents are placed in their source by buckets of
hashed ids, and shards number as many as a shard has slots (the square root of
all), so no source, bucket or shard grows into one task. A hot source is
spread over its buckets, shards and blocks.

Null and empty texts have size 0, are taken 0 times and count in no target. A
null source is a source. A null id is an id like others; rows alike in source,
id and size are placed by a hash of their text, and equal rows are interchangeable. One source alone
gets a target of all its words. No documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.scratch import stored
from tillpoint.operators.rowindex import with_row_index

WEIGHTS = (1, 2, 3)
BLOCK = 32  # words
MOST = 3  # times that a source, and each block of it, may be taken
LEAST_SHARD = 256  # slots
ROUNDS = 24  # of the shuffle
SEED = "12"
PRIME = 2_147_483_647  # of the shuffle's round bits
CHUNK = 1024  # sources whose running sums are taken together


def draw(*parts) -> Column:
    """A pseudorandom integer below 2**52 of the parts' text: 13 hex digits of their md5."""
    text = F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p))
                                           for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def round_keys(n: Column, *parts) -> Column:
    """The shuffle's ``ROUNDS`` keys of a permutation of n numbers (n >= 1)."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.struct(
        (draw(*parts, r, "a") % n).alias("a"), (draw(*parts, r, "c") % PRIME).alias("c")))


def permuted(i: Column, n: Column, keys: Column) -> Column:
    """Where the swap-or-not shuffle of 0 .. n-1 sends i: each round pairs x with key - x and swaps by a bit of the pair."""
    def swap(x, k):
        def by_bit(s):
            y = (F.greatest(x, s["other"]) % PRIME + k["c"]) % PRIME
            return F.when((y * y % PRIME * y % PRIME).bitwiseAND(F.lit(1)) == 1, s["other"]).otherwise(x)
        return F.get(F.transform(F.array(F.struct(F.pmod(k["a"] - x, n).alias("other"))), by_bit), F.lit(0))
    return F.aggregate(keys, i.cast("long"), swap)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size`` (words) and a hash of the text, written once."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        F.col(text_col).cast("string").alias("text"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return stored(plain.select("doc_id", "source", words.cast("long").alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")


def _before(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the sources numbered before, by chunks of sources and inside them."""
    rows = rows.withColumn("_chunk", F.floor(F.col("source_no") / CHUNK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("_chunk").agg(F.sum(value).alias("_s")).select(
        "_chunk", F.coalesce(F.sum("_s").over(earlier(Window.orderBy("_chunk"))), F.lit(0)).alias("_at"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_chunk").orderBy("source_no"))), F.lit(0))
    return rows.join(chunks, "_chunk").withColumn(out, (F.col("_at") + inside).cast("long")).drop("_chunk", "_at")


def water_level(sources: DataFrame, most: int = MOST) -> float:
    """Words per unit of weight at which targets, none above ``most`` times its size, share all words."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (total or 0) / (weight or 1), 0
    while True:
        over = F.col("weight") * level > most * F.col("source_size")
        n, full, weight = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
                                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not weight:
            return level
        level, stopped = (total - full) / weight, n


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row per source: number, weight, size, target, blocks, quota of slots and the quotas before; written once."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = with_row_index(totals, [F.asc_nulls_last("source")], "source_no", materialize="checkpoint")
    weighed = stored(numbered.withColumn("weight", F.get(F.lit(list(weights)), (F.col("source_no") % len(weights)).cast("int"))), "mix-sources")
    level = water_level(weighed, most)
    blocks = F.ceil(F.col("source_size") / block)
    planned = (weighed
               .withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double")))
               .withColumn("blocks", blocks)
               .withColumn("quota", F.when(F.col("source_size") > 0, F.least(
                   F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5), most * F.col("blocks"))).otherwise(0).cast("long")))
    return stored(_before(planned, "quota", "quota_at"), "mix-targets")


def round_table(sources: DataFrame) -> DataFrame:
    """``source_no, epoch, blocks, keys``: the permutation of each round through a source; written once."""
    epochs = F.explode(F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("blocks")).cast("int") - 1)).alias("epoch")
    used = sources.where("quota > 0").select("source_no", "blocks", epochs)
    return stored(used.withColumn("keys", round_keys(F.col("blocks"), "block", F.col("source_no"), F.col("epoch"))), "mix-keys")


def by_position(positions: DataFrame, sources: DataFrame, at: str, length: str, total: int, n_sources: int) -> DataFrame:
    """``positions`` (column ``pos`` below ``total``) with the ``source_no`` whose interval [at, at + length) holds it.

    Intervals are cut at a grid of as many cells as there are sources, so the join is by equal cells.
    """
    width = -(-total // max(1, n_sources))
    cells = sources.where(F.col(length) > 0).select(
        "source_no", F.col(at).alias("low"), (F.col(at) + F.col(length)).alias("high"),
        F.explode(F.sequence(F.floor(F.col(at) / width), F.floor((F.col(at) + F.col(length) - 1) / width))).alias("cell"))
    return positions.withColumn("cell", F.floor(F.col("pos") / width)).join(
        cells, "cell").where("pos >= low and pos < high").drop("cell", "high")


@dataclass
class Mixture:
    """The parts of a mixture."""

    documents: DataFrame  # doc_id, size, source_no, start: each document's place in its source's words
    sources: DataFrame
    slots: DataFrame  # shard, slot, source_no, epoch, block
    block: int

    def pieces(self) -> DataFrame:
        """``source_no, block, doc_id, start`` (of the document), ``size, offset`` (place in the block), ``first`` (word
        of the document) and ``words``: what each block holds of each document."""
        at = F.col("block") * self.block
        low, high = F.greatest("start", at), F.least(F.col("start") + F.col("size"), at + self.block)
        spread = self.documents.where("size > 0").select("*", F.explode(F.sequence(
            F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block))).alias("block"))
        return spread.select("source_no", "block", "doc_id", "start", "size", (low - at).alias("offset"),
                             (low - F.col("start")).alias("first"), (high - low).alias("words"))

    def rows(self) -> DataFrame:
        """The mixture itself: ``shard, slot, offset, source_no, block, doc_id, first, words``, a row per piece."""
        return self.slots.join(self.pieces(), ["source_no", "block"]).select(
            "shard", "slot", "offset", "source_no", "block", "doc_id", "first", "words")

    def taken(self) -> DataFrame:
        """``doc_id, size, source, source_size, target, taken`` for each document."""
        times = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        full = self.pieces().join(times, ["source_no", "block"], "left").groupBy("source_no", "start", "doc_id", "size").agg(
            F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).drop("start")
        empty = self.documents.where("size = 0").select("source_no", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        return full.unionByName(empty).join(self.sources.select("source_no", "source", "source_size", "target"), "source_no") \
                   .select("doc_id", "size", "source", "source_size", "target", "taken")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their ``start`` in their source's words: by bucket of hashed ids, then by id. Written once."""
    buckets = int(max(1, sizes.count()) ** 0.5) + 1
    number = sources.select("source_no", F.col("source").alias("_source"))
    rows = sizes.join(number, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "tie", "source_no", (draw("doc", F.col("doc_id")) % buckets).alias("bucket"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("_s")).select(
        "source_no", "bucket", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return stored(rows.withColumn("_n", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_no", "bucket"])
                      .select("doc_id", "size", "source_no", (F.col("_at") + F.col("_n")).alias("start")), "mix-documents")


def filled_slots(sources: DataFrame) -> DataFrame:
    """``shard, slot, source_no, epoch, block`` of every slot; written once."""
    spark = sources.sparkSession
    total, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count(F.lit(1))).first()
    per_shard = max(LEAST_SHARD, int(total ** 0.5))
    drawn_shards = total // per_shard // 2
    shard_of = lambda place: F.floor(place / per_shard)

    drawn = by_position(spark.range(drawn_shards * per_shard).select(
        shard_of(F.col("id")).alias("shard"), (F.col("id") % per_shard).alias("slot"), (draw("slot", F.col("id")) % max(1, total)).alias("pos")),
        sources, "quota_at", "quota", total, n_sources).select("shard", "slot", "source_no")
    drawn = stored(drawn, "mix-draws")
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("source_no", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("source_no", "shard").orderBy("slot")
    quotas = sources.select("source_no", "quota")
    kept = (drawn.withColumn("_n", F.row_number().over(inside) - 1).join(starts, ["source_no", "shard"]).join(quotas, "source_no")
                 .withColumn("t", F.col("_at") + F.col("_n")).where("t < quota").select("shard", "slot", "source_no", "t"))

    had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    left = sources.join(had, "source_no", "left").select(
        "source_no", F.least("quota", F.coalesce("had", F.lit(0))).alias("had"),
        F.greatest(F.col("quota") - F.coalesce("had", F.lit(0)), F.lit(0)).alias("left"))
    left = stored(_before(left, "left", "left_at"), "mix-left")
    rest = left.agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
    order = stored(spark.range(1).select(round_keys(F.lit(max(1, rest)), "settle").alias("keys")), "mix-order").first()["keys"]
    place = permuted(F.col("pos"), F.lit(max(1, rest)), F.array(*(F.struct(F.lit(k["a"]).alias("a"), F.lit(k["c"]).alias("c")) for k in order)))
    settled = (by_position(spark.range(rest).select(F.col("id").alias("pos")), left, "left_at", "left", max(1, rest), n_sources)
               .join(left.select("source_no", "had"), "source_no")
               .select("source_no", (F.col("had") + F.col("pos") - F.col("low")).alias("t"), place.alias("place"))
               .select((drawn_shards + shard_of(F.col("place"))).alias("shard"), (F.col("place") % per_shard).alias("slot"), "source_no", "t"))

    joined = (kept.unionByName(settled).join(sources.select("source_no", "blocks"), "source_no")
                  .withColumn("epoch", F.floor(F.col("t") / F.col("blocks")).cast("int"))
                  .join(round_table(sources).drop("blocks"), ["source_no", "epoch"]))
    return stored(joined.select("shard", "slot", "source_no", "epoch",
                                permuted(F.col("t") % F.col("blocks"), F.col("blocks"), F.col("keys")).alias("block")), "mix-slots")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS,
        block: int = BLOCK, most: int = MOST) -> Mixture:
    """The mixture of all documents' words."""
    sizes = sized(docs, id_col, text_col, source_col)
    sources = source_targets(sizes, weights, block, most)
    return Mixture(placed(sizes, sources), sources, filled_slots(sources), block)

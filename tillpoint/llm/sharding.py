"""Sharding by fixed virtual slots.

Records are hashed into ``SLOTS`` virtual slots that never change. Bytes are
summed per slot (partial sums before the shuffle), and a versioned
slot-to-shard map is stored as a table. The first version deals the slots,
largest first, each to the least loaded shard: the byte law, shard sizes near
equal. Rebalancing edits the map and stores the next version: a new shard
takes whole slots from the loaded ones until it has its share, all other slots
stay where they are, and records move only with their slot.

The maps have ``SLOTS`` rows whatever the input, so folding them in one
expression and broadcasting them is bounded. Rows are numbered inside a shard
by the counts of the slots (and parts of slots) before theirs, so neither a
shard nor a hot slot meets in one task.

Null texts have size 1. A null id is hashed like any other value. Equal rows
share a slot, which goes to a shard whole: the law holds up to the largest
slot. No rows give no rows (and a
map of empty slots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.scratch import shared_path, stored

SLOTS = 4096
SHARDS = 8
PARTS = 16  # of a slot's rows, by input partition: they are numbered apart, so a hot slot is not one task's
LAW = "bytes"


def slot_of(*keys: str, slots: int = SLOTS) -> Column:
    """Virtual slot of a record."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def record_size(text: str) -> Column:
    """UTF-8 bytes and one more."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, n_rows, n_bytes`` of all slots, empty ones too. ``sized`` has virtual_slot and size."""
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    used = sized.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return every.join(used, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("b", F.lit(0)).alias("n_bytes"))


def _moved(loads: Column, to: Column, n_bytes: Column, away: Column | None = None) -> Column:
    """Shard loads after a slot goes to ``to`` (and leaves ``away``)."""
    return F.transform(loads, lambda load, i: load + F.when(i == to, n_bytes).otherwise(0)
                       - (F.when(i == away, n_bytes).otherwise(0) if away is not None else 0))


def _fold(rows: DataFrame, loads: Column, choose, away=None) -> DataFrame:
    """Fold the array ``s`` of slots: ``choose(loads, slot)`` gives each slot's shard."""
    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def step(acc, x):
        to = choose(acc["loads"], x)
        entry = F.struct(x["virtual_slot"].alias("virtual_slot"), to.cast("int").alias("shard"))
        return F.struct(_moved(acc["loads"], to, x["n_bytes"], away(x) if away else None).alias("loads"),
                        F.array_append(acc["map"], entry).alias("map"))

    done = F.aggregate("s", F.struct(loads.alias("loads"), empty.alias("map")), step, lambda acc: acc["map"])
    return rows.select(F.explode(done).alias("m")).select("m.*")


def first_map(slots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``virtual_slot, shard``: largest slots first, each to the least loaded shard (ties: the lowest)."""
    rows = slots.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("o"), "virtual_slot", "n_bytes"))).alias("s"))
    return _fold(rows, F.array_repeat(F.lit(0).cast("long"), shards),
                 lambda loads, x: F.array_position(loads, F.array_min(loads)) - 1)


def grown_map(slots: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard, number ``shards``: it takes slots, largest first, that leave their shard at
    the new mean or above, until it has its share; no other slot moves."""
    have = slots.join(F.broadcast(current), "virtual_slot")
    loads = have.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("by_shard"), (F.sum("b") / (shards + 1)).alias("mean"))
    rows = have.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_bytes")).alias("o"), "virtual_slot", "n_bytes", "shard"))).alias("s")) \
               .crossJoin(loads)  # one row each

    def choose(now, x):
        moves = ((F.get(now, F.lit(shards)) + x["n_bytes"] <= F.col("mean")) & (F.get(now, x["shard"]) - x["n_bytes"] >= F.col("mean"))
                 & (x["n_bytes"] > 0))
        return F.when(moves, F.lit(shards)).otherwise(x["shard"])

    return _fold(rows, F.expr(f"transform(sequence(0, {shards}), i -> coalesce(element_at(by_shard, i), 0L))"),
                 choose, lambda x: x["shard"])


def store_map(spark: SparkSession, mapping: DataFrame, version: int, path: str | None = None) -> str:
    """Write one version of a slot map; the path of the map's table (one folder a version)."""
    path = path or shared_path(spark, "slot-map")
    mapping.coalesce(1).write.parquet(f"{path}/version={version}")
    return path


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}") \
                .withColumn("map_version", F.lit(version))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          slots: int = SLOTS) -> DataFrame:
    """One row per document: its size, checksum, shard, place in the shard and map version, and ``next_shard``: its
    shard by version 2 of the stored map, which is version 1 edited for one more shard."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    records = stored(plain.select(
        "doc_id", record_size("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of("doc_id", "text", slots=slots).alias("virtual_slot"),
        F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")), "shard-records")
    per_slot = slot_bytes(records, slots)
    path = store_map(spark, first_map(per_slot, shards), 1)
    first = read_map(spark, path, 1)
    grown = read_map(spark, store_map(spark, grown_map(per_slot, first, shards), 2, path), 2)
    mapping = first.join(F.broadcast(grown.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")  # ``slots`` rows each
    # at most SLOTS * PARTS counts, whatever the input
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    start = (records.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
                    .join(F.broadcast(mapping), "virtual_slot")
                    .select("virtual_slot", "part", "shard", "next_shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_at")))
    inside = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (records.withColumn("_n", F.row_number().over(inside) - 1)
                   .join(F.broadcast(start), ["virtual_slot", "part"])
                   .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                           (F.col("_at") + F.col("_n")).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "next_shard"))

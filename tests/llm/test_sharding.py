"""The byte law, gapless places, and maps that move only what they must."""

import zlib

from pyspark.sql import functions as F

from tillpoint.llm import sharding as H


def check(df, rows):
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        by.setdefault(r.shard, []).append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
                  for r in df.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    loads = [sum(r["size"] for r in by.get(s, [])) for s in range(8)]
    slots = {}
    for r in rows:
        slots[r.virtual_slot] = slots.get(r.virtual_slot, 0) + r["size"]
    assert max(loads) - min(loads) <= max(slots.values())
    return loads


def test_documents(documents):
    loads = check(documents, H.shard(documents).collect())
    assert max(loads) < 1.02 * min(loads)


def test_odd_rows_and_hot_rows(odd, frame):
    check(odd, H.shard(odd).collect())
    hot = frame([(1, "copy")] * 300 + [(i, f"text {i}" * (i % 7)) for i in range(600)])
    check(hot, H.shard(hot).collect())


def test_empty_table(frame):
    assert H.shard(frame([])).collect() == []


def test_place_does_not_depend_on_the_order_of_rows(documents):
    a = {r.doc_id: r.shard for r in H.shard(documents).collect()}
    b = {r.doc_id: r.shard for r in H.shard(documents.repartition(5)).collect()}
    assert a == b


def test_growth_moves_slots_only_into_the_new_shard(spark, documents):
    sized = documents.select(H.record_size("text").alias("size"), H.slot_of("doc_id", "text").alias("virtual_slot"))
    slots = H.slot_bytes(sized).cache()
    first = H.first_map(slots, 8)
    path = H.store_map(spark, first, 1)
    H.store_map(spark, H.grown_map(slots, H.read_map(spark, path, 1).drop("map_version"), 8), 2, path)
    one, two = (H.read_map(spark, path, v).select("virtual_slot", F.col("shard").alias(f"s{v}")) for v in (1, 2))
    rows = slots.join(one, "virtual_slot").join(two, "virtual_slot").collect()
    assert len(rows) == H.SLOTS
    assert all(r.s2 in (r.s1, 8) for r in rows)
    loads = [sum(r.n_bytes for r in rows if r.s2 == s) for s in range(9)]
    mean = sum(loads) / 9
    assert min(loads[:8]) >= mean * 0.999 and 0.8 * mean < loads[8] <= mean


def recomputed(rows, shards=8):
    """Both map versions, folded anew in Python from the rows' slots and sizes."""
    size = {}
    for r in rows:
        size[r.virtual_slot] = size.get(r.virtual_slot, 0) + r["size"]
    order = sorted(size, key=lambda v: (-size[v], v))
    loads, first = [0] * shards, {}
    for v in order:
        first[v] = loads.index(min(loads))
        loads[first[v]] += size[v]
    loads, grown, mean = [*loads, 0], dict(first), sum(loads) / (shards + 1)
    for v in order:
        if loads[shards] + size[v] <= mean and loads[first[v]] - size[v] >= mean:
            grown[v] = shards
            loads[shards] += size[v]
            loads[first[v]] -= size[v]
    return first, grown, loads


def test_both_versions_of_the_map_are_the_recomputed_ones(documents, odd, frame):
    hot = frame([(1, "copy")] * 300 + [(i, f"text {i}" * (i % 7)) for i in range(600)])
    for df in (documents, odd, hot):
        rows = H.shard(df).collect()
        first, grown, _ = recomputed(rows)
        assert all(r.shard == first[r.virtual_slot] and r.next_shard == grown[r.virtual_slot] for r in rows)
        assert all(r.next_shard in (r.shard, 8) for r in rows)
    rows = H.shard(documents).collect()
    _, _, loads = recomputed(rows)
    assert loads[8] > 0.8 * sum(loads) / 9

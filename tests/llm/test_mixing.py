"""Targets, quotas, the shuffle and the whole mixture; the DuckDB twin works the draws anew."""

import random

import pytest
from pyspark.sql import functions as F

from tillpoint.llm import mixing as M
from tillpoint.llm import queries


@pytest.fixture(scope="module")
def make(spark):
    def f(rows):
        return spark.createDataFrame([(i, s, t, "x", "x", "x") for i, s, t in rows],
                                     "doc_id long, source string, text string, size string, taken string, block string").repartition(3)
    return f


def reshared(sizes, most=3):
    """The contract's words, literally: targets by weight, stop at most times the size, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def check(rows, got):
    count = lambda t: len((t or "").encode().split())
    assert sorted((str(i), count(t), str(s)) for i, s, t in rows) == sorted((str(r.doc_id), r["size"], str(r.source)) for r in got)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    target, taken = reshared(sizes), {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3.5 * M.BLOCK
    return taken, target


def test_targets_stop_at_three_times_the_size(make):
    rows = [(i, "a", "w " * 900) for i in range(4)] + [(9, "b", "one two three"), (10, "c", "x " * 40), (11, "d", None),
                                                        (12, None, "y " * 300), (13, None, ""), (None, "e", "z " * 70)]
    taken, target = check(rows, M.mix(make(rows)).taken().collect())
    assert target["b"] == 9 and target["d"] == 0 and taken["d"] == 0


def test_one_source_and_odd_rows(make):
    rows = [(1, "s", "a b c"), (1, "s", "a b c"), (1, "s", "d e f g"), (None, "s", "n n"), (None, "s", "n n"), (2, "s", None), (3, "s", "")]
    taken, target = check(rows, M.mix(make(rows)).taken().collect())
    assert taken["s"] == target["s"] == 14
    empty = [(1, "s", None), (2, None, "")]
    assert [r.taken for r in M.mix(make(empty)).taken().collect()] == [0, 0]
    assert M.mix(make([])).taken().collect() == []


def test_hot_source_and_rerun(make):
    g = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 11}", "w " * g.randrange(200)) for i in range(600)]
    first = M.mix(make(rows)).taken().collect()
    check(rows, first)
    again = M.mix(make(rows[::-1]).repartition(7)).taken().collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mixture_rows_fill_their_slots(documents):
    m = M.mix(documents)
    rows, slots = m.rows().collect(), m.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots)
    per_shard = {}
    for s in slots:
        per_shard.setdefault(s.shard, set()).add(s.slot)
    assert sorted(per_shard) == list(range(len(per_shard)))
    in_slot = {}
    for r in rows:
        in_slot.setdefault((r.shard, r.slot), []).append((r.offset, r.words))
    for spans in in_slot.values():
        end = 0
        for offset, words in sorted(spans):
            assert offset == end
            end += words
        assert end <= M.BLOCK
    assert sum(sum(w for _, w in spans) == M.BLOCK for spans in in_slot.values()) > 0.9 * len(slots)
    counts = {}
    for s in slots:
        counts[s.source_no, s.block] = counts.get((s.source_no, s.block), 0) + 1
    assert max(counts.values()) <= M.MOST
    want = {r.doc_id: r.taken for r in m.taken().collect()}
    sums = {}
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.words
    assert {k: v for k, v in want.items() if v} == sums


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_shuffle_is_a_permutation(spark, n):
    keys = M.round_keys(F.lit(n), "test", n)
    got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n), keys)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 64:
        assert sum(a == b for a, b in enumerate(got)) < 12
        assert sum(b == a + 1 for a, b in zip(got, got[1:])) < 12


def test_whole_mixture_against_sql(spark, con):
    a = queries.op12(spark, "/root/testdata/sf0.001").toPandas()
    b = con.sql(queries.ORACLE["op12_source_mixing"]).df()[list(a.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (a, b))
    assert (a.drop(columns="target") == b.drop(columns="target")).all().all()
    assert (abs(a.target - b.target) < 1e-6).all()

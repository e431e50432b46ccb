"""Exact clusters against a plain Python version; bounds that never pass over a nearest centroid."""

import hashlib

import numpy as np
import pytest

from tillpoint.llm import centroids as K


def brute(rows, dims=64, k=40, rounds=5):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by integers of any size."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        got = {}
        for _, v in kept:
            got.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(got[j]) for x in zip(*got[j])] if j in got else c for j, c in enumerate(cs)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    of = {}
    for _, j, d in last:
        of[j] = of.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((str(i), j, d, of[j], sum(of.values()), sha[j]) for i, j, d in last)


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


@pytest.fixture(scope="module")
def make(spark):
    def f(rows):
        return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows],
                                     "vec_id long, embedding array<float>, cluster string, v double, distance int").repartition(3)
    return f


def test_odd_vectors_against_brute_force(make):
    g = np.random.default_rng(4)
    rows = [(i, g.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a hot vector
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[11][1]), (None, rows[12][1])]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [float("nan")] + [0.0] * 63),
             (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.001] * 64)]
    assert got(K.cluster(make(rows))) == brute(rows)


def test_ties_few_and_none(make):
    same = [(i, [1.0] * 64) for i in range(9)]
    assert got(K.cluster(make(same))) == brute(same)
    few = [(i, [float(i % 3)] + [0.0] * 63) for i in range(10)]
    assert got(K.cluster(make(few))) == brute(few)
    assert K.cluster(make([])).collect() == []
    assert K.cluster(make([(1, [1.0])])).collect() == []


def test_too_large_a_component_is_an_error(make):
    with pytest.raises(Exception, match="vector component"):
        K.cluster(make([(1, [1e30] * 64)])).collect()


def test_bounds_are_below_and_pass_over_most_of_clustered_data():
    g = np.random.default_rng(1)
    centres = g.integers(-4000, 4000, (40, 16))
    v = (centres[g.integers(0, 40, 3000)] + g.integers(-40, 40, (3000, 16))).astype(np.int64)
    pivots = K.choose_pivots(centres.astype(np.int64))
    cached = np.sqrt(K._squared(v, pivots).astype(float))
    b = K.Pivots(pivots, centres + g.integers(-9, 9, centres.shape))
    exact = K._squared(v, b.centroids)
    assert (b.bounds(cached) <= exact).all()
    label, best, compared = b.nearest(v, cached)
    assert (label == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert compared < 0.2 * 40 * len(v)


def test_bounds_hold_near_zero_and_at_the_largest_components():
    for size in (1, 3, K.LARGEST * K.SCALE - 1):
        g = np.random.default_rng(size)
        c = g.integers(-size, size + 1, (40, 64))
        v = np.concatenate([g.integers(-size, size + 1, (300, 64)), c, c + (c < size)])
        pivots = K.choose_pivots(c)
        b = K.Pivots(pivots, c)
        label, best, _ = b.nearest(v, np.sqrt(K._squared(v, pivots).astype(float)))
        exact = K._squared(v, c)
        assert (label == exact.argmin(1)).all() and (best == exact.min(1)).all()


def test_one_pivot_still_exact():
    v = np.arange(12, dtype=np.int64).reshape(6, 2)
    b = K.Pivots(v[:1], v[[1, 4]])
    label, best, _ = b.nearest(v, np.sqrt(K._squared(v, v[:1]).astype(float)))
    assert (best == K._squared(v, v[[1, 4]]).min(1)).all()

"""k nearest by runs of a space-filling order, over leaves, against brute force."""

import numpy as np
import pandas as pd
import pytest

from brute import kth_distance_brute
from tillpoint.cluster.knn import k_distance, k_distance_rows
from tillpoint.cluster.runs import Runs, interleaved


def frame(spark, x, key=None):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf["row_idx"] = np.arange(len(pdf))
    if key is not None:
        pdf["batch"] = key
    return spark.createDataFrame(pdf)


def breaks(x):
    return [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 200))) for i in range(x.shape[1])]


def test_codes_keep_each_dimension_in_order():
    x = np.sort(np.random.default_rng(1).normal(0, 1, (500, 1)) ** 3, axis=0)
    code = interleaved(x, breaks(x))
    assert (np.diff(code) >= 0).all() and code.min() >= 0 and len(np.unique(code)) > 490


@pytest.mark.parametrize("d", [1, 2, 4])
def test_near_in_one_leaf(d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 1e-4, (900, d)), rng.uniform(-5, 5, (900, d)), [[1e9] * d]])
    w = rng.integers(1, 3, len(x))
    order = np.argsort(interleaved(x, breaks(x)))
    q, i, d2, bound = Runs(np.zeros(len(x), np.int64)[order], x[order], None, w[order]).near(np.zeros(len(x), np.int64), x, 5)
    want = kth_distance_brute_weighted(x, w, 5)
    assert np.allclose(bound, want, rtol=1e-12, atol=0)
    assert len(q) < 12 * len(x)


def kth_distance_brute_weighted(x, w, k):
    d2 = sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1]))
    order = np.argsort(d2, axis=1, kind="stable")
    cum = np.cumsum(w[order], axis=1)
    return np.take_along_axis(np.take_along_axis(d2, order, 1), (cum >= k).argmax(1)[:, None], 1)[:, 0]


def test_work_on_a_dense_blob_in_a_sparse_field(monkeypatch):
    """Boxes opened per query stay about the same when the data grow eightfold."""
    def opened(n):
        rng = np.random.default_rng(7)
        x = np.concatenate([rng.normal(0, 1e-6, (n // 2, 2)), rng.uniform(-1, 1, (n // 2, 2))])
        x = x[np.argsort(interleaved(x, breaks(x)))]
        runs, count = Runs(np.zeros(n, np.int64), x, None, np.ones(n, np.int64)), [0]
        from tillpoint.cluster import runs as module
        real = module.kth_value
        monkeypatch.setattr(module, "kth_value", lambda q, *a: (count.__setitem__(0, count[0] + len(q)), real(q, *a))[1])
        runs.near(np.zeros(n, np.int64), x, 5)
        monkeypatch.setattr(module, "kth_value", real)
        return count[0] / n
    assert opened(16_000) < 2 * opened(2_000)


@pytest.mark.parametrize("d,k,leaf", [(2, 5, 16), (3, 4, 40), (1, 3, 7)])
def test_many_leaves_equal_brute_force(spark, d, k, leaf):
    rng = np.random.default_rng(leaf)
    x = np.round(np.concatenate([rng.normal(0, 1, (150, d)), rng.normal(5, 0.02, (150, d)), rng.uniform(-50, 50, (60, d)), [[1e7] * d]]), 2)
    x = np.concatenate([x, x[:20], x[:5]])
    rows = frame(spark, x)
    kd = k_distance(rows, [f"f{i}" for i in range(d)], k, leaf_points=leaf, visitors=9).toPandas().sort_values("pid")
    want = dict(zip(map(tuple, x), kth_distance_brute(x, k)))
    assert len(kd) == len(want) and kd.w.sum() == len(x)
    got = kd["kdist"].to_numpy()
    assert np.allclose(got, [want[tuple(p)] for p in kd[[f"x{i}" for i in range(d)]].to_numpy()], rtol=1e-12, atol=1e-12)


def test_keys_apart_and_too_few(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (120, 2))
    key = [f"b{i}" if i < 3 else f"b{3 + i % 3}" for i in range(120)]
    rows = frame(spark, x, key)
    got = k_distance_rows(rows, ["f0", "f1"], 4, keys=["batch"]).toPandas().sort_values("row_idx")
    small = k_distance(rows, ["f0", "f1"], 4, keys=["batch"], leaf_points=13).toPandas().set_index("pid")["kdist"]
    for b in set(key):
        at = np.array([i for i in range(120) if key[i] == b])
        if len(at) < 4:
            assert got.loc[got.batch == b, "kdist"].isna().all() and small[at].isna().all()
            continue
        want = kth_distance_brute(x[at], 4)
        assert np.allclose(got.loc[got.batch == b, "kdist"], want, rtol=1e-12)
        assert np.allclose(small[at], want, rtol=1e-12)


def test_no_rows(spark):
    assert k_distance(frame(spark, np.zeros((1, 2))).limit(0), ["f0", "f1"]).collect() == []

"""Grid DBSCAN and k-distance against brute force; mixture invariants."""

import numpy as np
import pandas as pd
import pytest

from brute import dbscan_brute, kth_distance_brute
from tillpoint.cluster.dbscan import dbscan
from tillpoint.cluster.knn import k_distance_rows
from tillpoint.cluster.mixture import assign_to_centres, elbow, fit_gmm, fit_kmeans, inertia_k1


def _frame(spark, x, extra=None):
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    pdf["row_idx"] = np.arange(len(pdf))
    if extra is not None:
        pdf["batch"] = extra
    return spark.createDataFrame(pdf)


def blobs(n=300, d=2, seed=7):
    rng = np.random.default_rng(seed)
    return np.round(np.concatenate([rng.normal(c, 0.3, size=(n // 3, d)) for c in (0, 2, 4)]), 2)


@pytest.mark.parametrize("d,eps,ms", [(2, 0.5, 5), (3, 0.45, 4), (2, 0.12, 3)])
def test_dbscan_equals_brute_force(spark, d, eps, ms):
    x = blobs(240, d)
    got = dbscan(_frame(spark, x), [f"f{i}" for i in range(d)], eps, ms).toPandas()
    got = got.sort_values("row_idx")["Cluster"].to_numpy()
    assert (got == dbscan_brute(x, eps, ms)).all()


def test_dbscan_border_and_exact_eps(spark):
    # a chain at exactly ε spacing, a border point between two clusters, noise, repeats
    pts = [(0.0, 0.0)] * 3 + [(0.5, 0.0), (1.0, 0.0), (1.5, 0.0)] + [(2.0, 0.0)] + \
          [(2.5, 0.0), (3.0, 0.0)] * 2 + [(3.0, 0.5)] * 2 + [(9.0, 9.0)]
    x = np.array(pts)
    got = dbscan(_frame(spark, x), ["f0", "f1"], 0.5, 3).toPandas().sort_values("row_idx")["Cluster"].to_numpy()
    assert (got == dbscan_brute(x, 0.5, 3)).all()


def test_dbscan_per_key_restarts_labels(spark):
    x = np.concatenate([blobs(150, 2, 1), blobs(150, 2, 2)])
    keys = np.repeat([1, 2], 150)
    got = dbscan(_frame(spark, x, keys), ["f0", "f1"], 0.4, 4, keys=["batch"]).toPandas().sort_values("row_idx")
    for b, lo in ((1, 0), (2, 150)):
        exp = dbscan_brute(x[lo:lo + 150], 0.4, 4)
        assert (got[got.batch == b]["Cluster"].to_numpy() == exp).all()


def test_dbscan_partition_independent(spark):
    x = blobs(180, 2, 3)
    res = []
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        res.append(dbscan(_frame(spark, x), ["f0", "f1"], 0.3, 4).toPandas().sort_values("row_idx")["Cluster"].to_numpy())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert (res[0] == res[1]).all() and (res[1] == res[2]).all()


@pytest.mark.parametrize("d,k", [(2, 5), (2, 3), (3, 4)])
def test_k_distance_equals_brute_force(spark, d, k):
    rng = np.random.default_rng(d * 10 + k)
    x = np.round(np.concatenate([rng.normal(0, 1, size=(180, d)), rng.normal(6, 0.05, size=(12, d))]), 1)
    got = k_distance_rows(_frame(spark, x), [f"f{i}" for i in range(d)], k).toPandas()
    got = got.sort_values("row_idx")["kdist"].to_numpy()
    assert np.allclose(got, kth_distance_brute(x, k), rtol=0, atol=1e-12)


def test_assignment_first_on_ties(spark):
    df = _frame(spark, np.array([[1.0, 0.0], [0.0, 0.0], [2.0, 0.0]]))
    out = assign_to_centres(df, ["f0", "f1"], [[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]]).toPandas()
    assert out.sort_values("row_idx")["Cluster"].tolist() == [0, 0, 1]


def test_kmeans_and_gmm_invariants(spark):
    df = _frame(spark, blobs(300, 2, 5))
    _, km, centres = fit_kmeans(df, ["f0", "f1"], 3, seed=42)
    pk = km.toPandas()
    assert set(pk["Cluster"]) <= {0, 1, 2} and len(pk) == 300 and len(centres) == 3
    _, again, _ = fit_kmeans(df, ["f0", "f1"], 3, seed=42)
    assert (again.toPandas().sort_values("row_idx")["Cluster"].to_numpy()
            == pk.sort_values("row_idx")["Cluster"].to_numpy()).all()
    model, gm = fit_gmm(df, ["f0", "f1"], 3, seed=0)
    assert abs(sum(model.weights) - 1) < 1e-9
    assert gm.groupBy("cluster").count().toPandas()["count"].sum() == 300


def test_gmm_weighted_collapse(spark):
    """EM over weighted distinct points: every copy of a point gets the same
    label, sizes add up to all rows, and a rerun gives the same labels."""
    x = np.repeat(blobs(120, 2, 11), 4, axis=0)
    df = _frame(spark, x)
    model, gm = fit_gmm(df, ["f0", "f1"], 3, seed=0)
    assert abs(sum(model.weights) - 1) < 1e-9
    p = gm.toPandas().sort_values("row_idx")
    assert len(p) == 480
    assert (p.groupby(["f0", "f1"])["cluster"].nunique() == 1).all()
    _, again = fit_gmm(df, ["f0", "f1"], 3, seed=0)
    q = again.toPandas().sort_values("row_idx")
    assert (q["cluster"].to_numpy() == p["cluster"].to_numpy()).all()


def test_elbow_k1_is_total_squared_deviation(spark):
    x = blobs(90, 2, 9)
    df = _frame(spark, x)
    k1 = inertia_k1(df, ["f0", "f1"]).first()["inertia"]
    assert abs(k1 - ((x - x.mean(0)) ** 2).sum()) < 1e-6
    e = elbow(df, ["f0", "f1"], 4).toPandas()
    assert e["k"].tolist() == [1, 2, 3] and e["inertia"].is_monotonic_decreasing

"""PCA of the encoded matrix equals the dense one; the Krylov rounds converge on wide matrices."""

import numpy as np
import pandas as pd

from tillpoint.operators.encoded_pca import fit_encoded_pca, leading_eigenpairs


def _dense(pdf, numeric, categorical):
    parts = [pdf[numeric].astype(float)]
    parts += [pd.get_dummies(pdf[c], prefix=c, drop_first=True).astype(float) for c in categorical]
    x = pd.concat(parts, axis=1)
    vals, vecs = np.linalg.eigh(np.cov(x.to_numpy().T))
    return x, vals[::-1], vecs[:, ::-1].T


def _check(spark, pdf, numeric, categorical, schema, k=3):
    fit = fit_encoded_pca(spark.createDataFrame(pdf, schema), numeric, categorical, k)
    x, vals, comps = _dense(pdf, numeric, categorical)
    assert fit.features == list(x.columns)
    assert np.allclose(fit.explained_variance, vals[:k]) and np.allclose(fit.explained_variance_ratio, vals[:k] / vals.sum())
    signs = np.sign((fit.components * comps[:k]).sum(1))
    assert np.allclose(fit.components, comps[:k] * signs[:, None], atol=1e-6)
    assert (np.take_along_axis(fit.components, np.abs(fit.components).argmax(1)[:, None], 1) > 0).all()
    return fit, x


def test_two_categories_and_nulls(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"row": np.arange(n), "a": rng.normal(1e6, 3, n), "b": rng.normal(0, 1, n),
                        "c": rng.choice(list("pqrst"), n), "d": rng.choice(["u", "v", None], n)})
    schema = "row long, a double, b double, c string, d string"
    fit, x = _check(spark, pdf, ["a", "b"], ["c", "d"], schema)
    got = fit.transform(spark.createDataFrame(pdf, schema)).toPandas().sort_values("row")
    want = (x.to_numpy() - x.to_numpy().mean(0)) @ fit.components.T
    assert np.allclose(got[["pc1", "pc2", "pc3"]].to_numpy(), want, atol=1e-6)
    hole = spark.createDataFrame([(0, None, 1.0, "p", "u")], schema)
    assert fit.transform(hole).first()["pc1"] is None
    with_hole = spark.createDataFrame(pdf, schema).unionByName(hole)
    assert np.allclose(fit_encoded_pca(with_hole, ["a", "b"], ["c", "d"], 3).components, fit.components)


def test_more_dummies_than_a_basis_holds(spark):
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({"a": rng.normal(0, 2, n), "c": [f"k{int(v):03d}" for v in rng.exponential(25, n)]})
    _check(spark, pdf, ["a"], ["c"], "a double, c string", 2)


def test_restarts_reach_the_leading_pairs():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    vals = np.r_[5.0, 4.8, np.linspace(4.5, 0.0, 298)]
    m = (q * vals) @ q.T
    got, vecs = leading_eigenpairs(lambda b: m @ b, 300, 2, rng.normal(size=(300, 8)))
    assert np.allclose(got, [5.0, 4.8]) and np.allclose(np.abs(vecs.T @ q[:, :2]), np.eye(2), atol=1e-6)


def test_one_column_without_spread(spark):
    fit = fit_encoded_pca(spark.createDataFrame([(1.0, "x")] * 5, "a double, c string"), ["a"], ["c"], 1)
    assert fit.features == ["a"] and fit.explained_variance[0] == 0 and fit.explained_variance_ratio[0] == 0

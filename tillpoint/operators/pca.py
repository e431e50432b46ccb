"""PCA (T7) and explained variance ratio.

The d×d covariance comes from one aggregate (means and co-moments,
partially aggregated on every partition); only that d×d matrix reaches the
driver for the eigen-decomposition. Scores are then plain linear column
expressions of the centred inputs, so projecting stays in codegen and
needs no vector column. Sign rule: in each component the loading with the
largest absolute value is made positive (first one on ties).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PCAFit:
    cols: list[str]
    mean: np.ndarray
    components: np.ndarray          # k × d
    explained_variance: np.ndarray  # k eigenvalues (sample covariance)
    explained_variance_ratio: np.ndarray
    n: int

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        exprs = {}
        for i, comp in enumerate(self.components):
            e = None
            for c, m, w in zip(self.cols, self.mean, comp):
                t = (F.col(c) - F.lit(float(m))) * F.lit(float(w))
                e = t if e is None else e + t
            exprs[f"{prefix}{i + 1}"] = e
        return df.withColumns(exprs)

    def variance_frame(self, spark) -> DataFrame:
        rows = [(i + 1, float(v), float(r)) for i, (v, r) in
                enumerate(zip(self.explained_variance, self.explained_variance_ratio))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double")


def _orient(vec: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    mags = np.abs(vec)
    top = int(np.argmax(mags >= mags.max() - tol))
    return vec if vec[top] >= 0 else -vec


def fit_pca(df: DataFrame, cols: list[str], k: int = 2) -> PCAFit:
    d = len(cols)
    if k > d:
        raise ValueError("k cannot exceed the number of columns")
    x = [F.col(c).cast("double") for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(d)]
    # covar_samp is Spark's streaming (Welford-style) co-moment: stable at any scale.
    aggs += [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    clean = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    row = clean.agg(*aggs).first()
    n = int(row["n"])
    if n < 2:
        raise ValueError("PCA needs at least two complete rows")
    mean = np.array([row[f"m{i}"] for i in range(d)], dtype=float)
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    comps = np.array([_orient(vecs[:, i]) for i in range(k)])
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    return PCAFit(list(cols), mean, comps, vals[:k], ratio[:k], n)

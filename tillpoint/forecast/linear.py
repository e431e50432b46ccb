"""Least squares for many series at once, by grouped normal equations.

The Gram matrix XᵀX and Xᵀy of every series are accumulated per partition
(numpy on Arrow batches) and merged per series key; only those d×d numbers
per key are solved, in a small pandas function applied to one row per key.
Predictions are then a join on the key plus a linear
column expression. The design never leaves the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers a task holds before it emits its partial sums (8 bytes each).
PARTIAL_ENTRIES = 4_000_000


def fit_least_squares(df: DataFrame, features: list[str], target: str,
                      keys: list[str] | None = None, ridge: float = 1e-6,
                      intercept: bool = True, penalise: list[str] | None = None) -> DataFrame:
    """Coefficients per key: ``keys…, coef (array<double>), n``.

    ``coef[0]`` is the intercept when ``intercept``; the ridge term
    ``ridge·trace/d`` is added to the penalised diagonal (all features by
    default, never the intercept).

    Each partition folds its rows into one partial (XᵀX, Xᵀy, n) per key
    with numpy, entry by entry; Spark sums the entries (partial sums before the
    shuffle) and each key's are solved in one small pandas call. A key without
    a complete row has no coefficients and no row.
    """
    keys = list(keys or [])
    cols = list(features)
    d = len(cols) + (1 if intercept else 0)
    data = df.where(F.col(target).isNotNull())
    for c in features:
        data = data.where(F.col(c).isNotNull())
    data = data.select(*keys, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(cols)],
                       F.col(target).cast("double").alias("_y"))
    key_fields = [f for f in data.schema.fields if f.name in keys]
    part_schema = T.StructType(key_fields + [
        T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
    fcols = [f"_f{i}" for i in range(len(cols))]

    def rows_of(acc: dict) -> pd.DataFrame:
        """One row per key and entry of (XᵀX, Xᵀy, n), so that Spark sums them with partial sums."""
        rows = [[*k, i, float(v)] for k, m in acc.items() for i, v in enumerate(m)]
        return pd.DataFrame(rows, columns=keys + ["i", "v"])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                X = g[fcols].to_numpy(dtype=float)
                if intercept:
                    X = np.hstack([np.ones((len(X), 1)), X])
                y = g["_y"].to_numpy(dtype=float)
                m = np.concatenate([(X.T @ X).ravel(), X.T @ y, [len(X)]])
                acc[k] = acc[k] + m if k in acc else m
                if len(acc) * len(m) > PARTIAL_ENTRIES:
                    yield rows_of(acc)
                    acc = {}
        if acc:
            yield rows_of(acc)

    parts = data.mapInPandas(partial, part_schema)
    entries = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    # d * d + d + 1 numbers for each key
    gram = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")) \
                  .select(*keys, F.col("m.v").alias("m")).where(F.size("m") > 0)
    pen = set(penalise if penalise is not None else features)
    pen_idx = [i + (1 if intercept else 0) for i, c in enumerate(cols) if c in pen]
    out_schema = T.StructType(key_fields + [
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            m = np.array(r["m"], dtype=float)
            G, b, n = m[:d * d].reshape(d, d), m[d * d:-1], m[-1]
            lam = ridge * (np.trace(G) / d if d else 0.0)
            for i in pen_idx:
                G[i, i] += lam
            coef = np.linalg.lstsq(G, b, rcond=None)[0]
            rows.append([r[k] for k in keys] + [coef.tolist(), int(n)])
        return pd.DataFrame(rows, columns=keys + ["coef", "n"])

    if keys:
        return gram.groupBy(*keys).applyInPandas(solve, out_schema)
    return gram.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(solve, out_schema)


def linear_prediction(features: list[str], intercept: bool = True, coef_col: str = "coef") -> Column:
    e = F.col(coef_col)[0] if intercept else F.lit(0.0)
    off = 1 if intercept else 0
    for i, c in enumerate(features):
        e = e + F.col(coef_col)[i + off] * F.col(c)
    return e


def predict(df: DataFrame, coefs: DataFrame, features: list[str], keys: list[str] | None = None,
            out_col: str = "prediction", intercept: bool = True) -> DataFrame:
    keys = list(keys or [])
    j = df.join(coefs.drop("n"), keys) if keys else df.crossJoin(F.broadcast(coefs.drop("n")))
    return j.withColumn(out_col, linear_prediction(features, intercept)).drop("coef")

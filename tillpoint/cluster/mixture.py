"""K-Means (G1, G2), Gaussian mixture (G3) and exact assignment steps.

Fits use MLlib (distributed Lloyd / EM over cached vectors). The assignment
step with fixed centres is an ordinary column expression, so it is exact
and checkable in SQL: nearest centre by squared Euclidean distance, lowest
index on ties.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.cluster.lloyd import Leaves, lloyd
from tillpoint.operators.encode import assemble
from tillpoint.operators.scale import scale as scale_cols
from tillpoint.session import cut_lineage

FEW_ROWS = 1 << 18  # K-Means rounds over fewer are left to MLlib


def nearest_centre(cols: list[str], centres: list[list[float]]) -> Column:
    """Index of the closest centre (squared distance, first on ties)."""
    d2 = []
    for c in centres:
        e = None
        for col, v in zip(cols, c):
            t = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            e = t if e is None else e + t
        d2.append(e)
    best = F.lit(len(centres) - 1)
    for j in range(len(centres) - 2, -1, -1):
        cond = None
        for m in range(j + 1, len(centres)):
            t = d2[j] <= d2[m]
            cond = t if cond is None else cond & t
        for m in range(j):
            cond = cond & (d2[j] < d2[m])
        best = F.when(cond, F.lit(j)).otherwise(best)
    return best.cast("int")


def assign_to_centres(df: DataFrame, cols: list[str], centres: list[list[float]],
                      out_col: str = "Cluster") -> DataFrame:
    """G1 assignment step with fixed centres (exact)."""
    return df.withColumn(out_col, nearest_centre(cols, centres))


def fit_kmeans(df: DataFrame, feature_cols: list[str], k: int, seed: int = 42,
               scale: bool = False, max_iter: int = 300, tol: float = 1e-4,
               out_col: str = "Cluster"):
    """G1: fit K-Means on the (unscaled by default, B11) features and label
    every row; returns (model, labelled DataFrame, centres)."""
    data = scale_cols(df, feature_cols, "standard") if scale else df
    rows = assemble(data, feature_cols, "_features")
    vec = cut_lineage(rows.select("_features"), "persist")  # the rounds need no other column
    (model, _), = _fitted(vec, [k], seed, max_iter, tol, out_col)
    vec.unpersist()
    out = model.transform(rows).drop("_features")
    return model, out, [list(map(float, c)) for c in model.clusterCenters()]


def _fitted(vec: DataFrame, ks: list[int], seed: int, max_iter: int, tol: float, out_col: str = "prediction") -> list[tuple[KMeansModel, float]]:
    """MLlib's K-Means model and inertia for each of ``ks`` over the cached ``_features`` of ``vec``.

    MLlib chooses the first centres (k-means||, seeded) at all sizes. Over few rows it also runs the rounds; over many the
    fits go on together on leaves (``lloyd.py``), which gives the same rounds without reading every row in each.
    """
    def fit(k: int, rounds: int) -> KMeansModel:
        return KMeans(k=k, seed=seed, maxIter=rounds, tol=tol, featuresCol="_features", predictionCol=out_col).fit(vec)

    def whole(k: int) -> tuple[KMeansModel, float]:
        model = fit(k, max_iter)
        return model, float(model.summary.trainingCost)

    with ThreadPoolExecutor(max(1, len(ks))) as pool:  # each is many short jobs that leave cores idle
        if not ks or vec.count() < FEW_ROWS or max_iter < 1:
            return list(pool.map(whole, ks))
        starts = list(pool.map(lambda k: np.array(fit(k, 0).clusterCenters()), ks))
        leaves = Leaves(vec)
        ends = lloyd(leaves, starts, max_iter, tol)
        leaves.close()
        return list(pool.map(lambda k, end: whole(k) if end is None else (_model(vec, end[0], out_col), end[1]), ks, ends))


def _model(vec: DataFrame, centres: np.ndarray, out_col: str) -> KMeansModel:
    """MLlib's model with these centres."""
    sc = vec.sparkSession.sparkContext
    rows = sc._jvm.java.util.ArrayList()
    for c in centres:
        rows.add(sc._jvm.org.apache.spark.mllib.linalg.Vectors.dense(float(c[0]), sc._jvm.PythonUtils.toSeq([float(v) for v in c[1:]])))
    parent = sc._jvm.org.apache.spark.mllib.clustering.KMeansModel(rows)
    model = KMeansModel(sc._jvm.org.apache.spark.ml.clustering.KMeansModel(f"KMeans_{uuid.uuid4().hex[:12]}", parent))
    return model.setFeaturesCol("_features").setPredictionCol(out_col)


def _deviation(vec: DataFrame) -> DataFrame:
    """``k`` = 1 and Σ squared deviation of ``_features`` from their mean."""
    stats = Summarizer.metrics("count", "variance").summary(F.col("_features"))
    one = vec.agg(stats.alias("s"))  # sample variances, of vector columns too
    squares = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v)
    return one.select(F.lit(1).alias("k"), (squares * (F.col("s.count") - 1)).alias("inertia"))


def inertia_k1(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Inertia for one cluster: Σ squared deviation from the mean (MLlib rejects k = 1)."""
    return _deviation(assemble(df, feature_cols, "_features"))


def elbow(df: DataFrame, feature_cols: list[str], max_k: int = 10, seed: int = 42,
          max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """``k, inertia`` for k = 1 … max_k − 1 on one cached vector frame, fitted as G1 fits.

    The fits go on together (``_fitted``).
    """
    spark = df.sparkSession
    vec = cut_lineage(assemble(df, feature_cols, "_features").select("_features"), "persist")
    ks = list(range(2, max_k))
    costs = [cost for _, cost in _fitted(vec, ks, seed, max_iter, tol)]
    rows = [(1, float(_deviation(vec).first()["inertia"]))] + list(zip(ks, costs))
    vec.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double")


def mixture_log_density(cols: list[str], weight: float, mean: list[float], cov: list[list[float]]) -> Column:
    """log(weight · N(x; mean, cov)) as a column expression (constants from the small matrix on the driver)."""
    precision = np.linalg.inv(np.array(cov, dtype=float))
    d = len(cols)
    const = float(np.log(weight) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(np.array(cov, dtype=float))[1]))
    form = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            form = form + (F.col(cols[i]) - F.lit(float(mean[i]))) * (F.col(cols[j]) - F.lit(float(mean[j]))) \
                * F.lit(float(precision[i, j]))
    return F.lit(const) - F.lit(0.5) * form


def assign_mixture(df: DataFrame, cols: list[str], weights: list[float], means: list[list[float]],
                   covs: list[list[list[float]]], out_col: str = "cluster") -> DataFrame:
    """G3 assignment with fixed parameters: the most probable component (first on ties) and its probability."""
    logs = [mixture_log_density(cols, *p) for p in zip(weights, means, covs)]
    names = [f"_l{k}" for k in range(len(logs))]
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    total = sum((F.exp(F.col(n) - top) for n in names), F.lit(0.0))
    return (df.withColumns(dict(zip(names, logs)))
              .withColumn(out_col, (F.array_position(F.array(*names), top) - 1).cast("int"))
              .withColumn("probability", 1 / total).drop(*names))


def fit_gmm(df: DataFrame, feature_cols: list[str], k: int = 3, seed: int = 0,
            max_iter: int = 100, tol: float = 1e-3, out_col: str = "cluster"):
    """Gaussian mixture (full covariances) + hard label = most probable component.

    EM runs over the *distinct* feature points weighted by their row counts
    (``weightCol``): each E/M step is a weighted sum, so equal rows contribute
    exactly as one point of their total weight, and every iteration scans the
    (much smaller) distinct set instead of all rows. The collapse is a groupBy
    with map-side partial aggregation, so one hot point does not make a hot
    task. MLlib caches the weighted instances itself (input left unpersisted);
    the points are sorted inside their partitions so the seeded initial sample
    is the same on every run. Labels come from one map-only pass over the rows.
    """
    pts = (df.groupBy(*feature_cols).agg(F.count(F.lit(1)).cast("double").alias("_w"))
             .sortWithinPartitions(*feature_cols))
    vec = assemble(pts, feature_cols, "_features").select("_features", "_w")
    model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_features",
                            weightCol="_w", predictionCol=out_col, probabilityCol="_prob").fit(vec)
    out = model.transform(assemble(df, feature_cols, "_features")) \
               .withColumn("probability", vector_to_array("_prob")) \
               .drop("_features", "_prob")
    return model, out


def fit_bisecting(df: DataFrame, feature_cols: list[str], k: int, seed: int = 42,
                  out_col: str = "Cluster"):
    """G10 (the menu's hierarchical clustering, which has no body in the
    original): divisive bisecting K-Means; returns (model, labelled rows)."""
    from pyspark.ml.clustering import BisectingKMeans

    vec = assemble(df, feature_cols, "_features").persist(StorageLevel.MEMORY_AND_DISK)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out_col).fit(vec)
    return model, model.transform(vec).drop("_features")

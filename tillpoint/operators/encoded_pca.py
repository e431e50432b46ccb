"""PCA of an encoded matrix (T7, T8 over T5/T6): numeric columns beside the dummies of categorical ones.

The encoded matrix is never built. One pass groups the rows by their
categories and sums counts, numeric values and their products; the cross
products of all encoded columns (the Gram matrix, sparse) follow from that
small aggregate: a dummy times a dummy is a count, a dummy times a number a
sum. Numeric values are shifted by their means first, and the centring of the
dummies stays implicit: ``C = (G − n·μμᵀ) / (n − 1)``.

The Gram entries stay a table. The leading components come from a block
Krylov method with Rayleigh–Ritz steps and thick restarts: a round joins the
entries with one block of vectors and sums by row. The driver holds vectors
of one number per encoded column, as the fitted model does, never a matrix of
columns by columns. Components are oriented as in ``pca``.

Rows with a null in a numeric column take no part in the fit and get null
scores; a null category has no dummy set, as in ``one_hot``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.encode import label_codes
from tillpoint.operators.pca import _orient
from tillpoint.session import cut_lineage

#: Encoded columns a model may have: its vectors are on the driver (MLlib's PCA stops at 65,535).
MAX_FEATURES = 200_000
#: Vectors beyond the asked components in a block, and blocks in the basis before a restart.
EXTRA, BLOCKS = 6, 4


@dataclass
class EncodedPCA:
    numeric: list[str]
    levels: dict[str, list]         # categories with a dummy, in sorted order (the first category has none)
    mean: np.ndarray                # of the encoded columns: numeric ones, then the dummies
    components: np.ndarray          # k × d
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray
    n: int

    @property
    def features(self) -> list[str]:
        return list(self.numeric) + [f"{c}_{v}" for c, vs in self.levels.items() for v in vs]

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Scores: a linear expression of the numeric columns plus one looked-up loading a categorical column."""
        spark, k, s = df.sparkSession, len(self.components), len(self.numeric)
        out, start, parts = df, s, [[] for _ in range(k)]
        for c, vs in self.levels.items():
            if vs:
                rows = [(v, [float(w) for w in self.components[:, start + i]]) for i, v in enumerate(vs)]
                table = spark.createDataFrame(rows, f"_v {df.schema[c].dataType.simpleString()}, _w_{c} array<double>")
                out = out.join(table, F.col(c) == F.col("_v"), "left").drop("_v")
                for j in range(k):
                    parts[j].append(F.coalesce(F.col(f"_w_{c}")[j], F.lit(0.0)))
            start += len(vs)
        for j, w in enumerate(self.components):
            centred = [(F.col(c).cast("double") - F.lit(float(m))) * F.lit(float(x))
                       for c, m, x in zip(self.numeric, self.mean, w)]
            offset = F.lit(-float(self.mean[s:] @ w[s:]))
            out = out.withColumn(f"{prefix}{j + 1}", reduce(lambda a, b: a + b, [*centred, *parts[j], offset]))
        return out.drop(*[f"_w_{c}" for c, vs in self.levels.items() if vs])

    def loadings_frame(self, spark) -> DataFrame:
        cols = ", ".join(f"pc{j + 1} double" for j in range(len(self.components)))
        return spark.createDataFrame([(f, *map(float, self.components[:, i])) for i, f in enumerate(self.features)],
                                     f"feature string, {cols}")

    def variance_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v), float(x)) for i, (v, x) in enumerate(
            zip(self.explained_variance, self.explained_variance_ratio))], "component int, variance double, ratio double")


def gram_entries(df: DataFrame, numeric: list[str], shift: list[float], coded: dict[str, DataFrame],
                 first: dict[str, int], categorical: list[str]) -> DataFrame:
    """Entries ``i, j, v`` (both triangles) of XᵀX for the numeric columns less ``shift`` and the dummies.
    ``coded[c]`` maps a category to its code; code t > 0 is encoded column ``first[c] + t − 1``."""
    x = [F.col(c).cast("double") - F.lit(m) for c, m in zip(numeric, shift)]
    s = len(numeric)
    sums = [F.count(F.lit(1)).cast("double").alias("_n")] + [F.sum(x[a]).alias(f"_s{a}") for a in range(s)]
    sums += [F.sum(x[a] * x[b]).alias(f"_q{a}_{b}") for a in range(s) for b in range(a, s)]
    moments = df.groupBy(*categorical).agg(*sums)
    for c in categorical:
        moments = moments.join(coded[c].withColumnRenamed(f"{c}_code", f"_e_{c}"), c, "left")

    def entry(i, j, v):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.alias("v"))

    def both(i, j, v):
        return [entry(i, j, v), entry(j, i, v)]

    dummy = {c: F.when(F.col(f"_e_{c}") > 0, F.col(f"_e_{c}") + F.lit(first[c] - 1)) for c in categorical}
    items = [e for a in range(s) for b in range(a, s) for e in
             (both if a < b else lambda *z: [entry(*z)])(F.lit(a), F.lit(b), F.col(f"_q{a}_{b}"))]
    for m, c in enumerate(categorical):
        items.append(entry(dummy[c], dummy[c], F.col("_n")))
        items += [e for a in range(s) for e in both(F.lit(a), dummy[c], F.col(f"_s{a}"))]
        items += [e for o in categorical[m + 1:] for e in both(dummy[c], dummy[o], F.col("_n"))]
    return (moments.select(F.explode(F.array(*items)).alias("t")).select("t.i", "t.j", "t.v")
                   .where("i IS NOT NULL AND j IS NOT NULL").groupBy("i", "j").agg(F.sum("v").alias("v")))


def _times(gram: DataFrame, block: np.ndarray) -> np.ndarray:
    """Gram matrix times a block of vectors: a join on the column number and a sum by row."""
    d, b = block.shape
    spark = gram.sparkSession
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(block)], "j int, q array<double>")
    sums = [F.sum(F.col("v") * F.col("q")[c]).alias(f"p{c}") for c in range(b)]
    got = gram.join(q, "j").groupBy("i").agg(*sums).toPandas()
    out = np.zeros((d, b))
    out[got["i"].to_numpy()] = got[[f"p{c}" for c in range(b)]].to_numpy()
    return out


def leading_eigenpairs(times, d: int, k: int, start: np.ndarray, tol: float = 1e-13,
                       max_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues and their vectors (d × k) of a symmetric positive operator known by ``times``.

    A basis grows by the new directions of each product and is orthogonalised twice; Rayleigh–Ritz pairs whose
    residual is over ``tol`` of the greatest value go on, from the best Ritz vectors once the basis is full."""
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = np.linalg.qr(start)[0]
    for _ in range(max_rounds):
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
        small = basis.T @ image
        vals, vecs = np.linalg.eigh((small + small.T) / 2)
        vals, vecs = vals[::-1], vecs[:, ::-1]
        ritz, mapped = basis @ vecs, image @ vecs
        resid = mapped[:, :k] - ritz[:, :k] * vals[:k]
        if basis.shape[1] >= d or np.linalg.norm(resid, axis=0).max() <= tol * max(vals[0], 1e-300):
            return vals[:k], ritz[:, :k]
        if basis.shape[1] + block.shape[1] > BLOCKS * start.shape[1]:
            keep = start.shape[1]
            basis, image = ritz[:, :keep], mapped[:, :keep]
        new = mapped[:, :start.shape[1]] - ritz[:, :start.shape[1]] * vals[:start.shape[1]]
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        u, size, _ = np.linalg.svd(new, full_matrices=False)
        block = u[:, size > 1e-10][:, :d - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            return vals[:k], ritz[:, :k]
    raise ArithmeticError("components did not converge")


def fit_encoded_pca(df: DataFrame, numeric: list[str], categorical: list[str], k: int = 2) -> EncodedPCA:
    """The k leading components of the columns ``numeric`` and the dummies (without the first) of ``categorical``."""
    rows = df.select(*numeric, *categorical).dropna(subset=numeric)
    head = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}")
                                                   for i, c in enumerate(numeric)]).first()
    n, shift = int(head["n"]), [head[f"m{i}"] for i in range(len(numeric))]
    if n < 2:
        raise ValueError("PCA needs at least two complete rows")
    coded, levels, first, d = {}, {}, {}, len(numeric)
    for c in categorical:
        distinct = rows.select(c).where(F.col(c).isNotNull()).distinct()
        coded[c] = cut_lineage(label_codes(distinct, c, f"{c}_code"))
        found = coded[c].where(F.col(f"{c}_code") > 0).count()
        if d + found > MAX_FEATURES:
            raise ValueError(f"{d + found} encoded columns, {MAX_FEATURES} at most")
        levels[c] = [r[0] for r in coded[c].where(F.col(f"{c}_code") > 0).orderBy(f"{c}_code").select(c).collect()]
        first[c], d = d, d + found
    if k > d:
        raise ValueError("k cannot exceed the number of columns")
    gram = cut_lineage(gram_entries(rows, numeric, shift, coded, first, categorical))
    diagonal = np.zeros(d)
    for r in gram.where("i = j").select("i", "v").collect():
        diagonal[r["i"]] = r["v"]
    mean = diagonal / n                      # a dummy's square is itself
    mean[:len(numeric)] = 0.0                # shifted by their means
    variance = (diagonal - n * mean * mean) / (n - 1)

    def times(block: np.ndarray) -> np.ndarray:
        return (_times(gram, block) - n * np.outer(mean, mean @ block)) / (n - 1)

    width = min(d, k + EXTRA)
    start = np.random.default_rng(7).normal(size=(d, width)) * np.sqrt(np.maximum(variance, 0))[:, None]
    start[np.argsort(-variance, kind="stable")[:width], np.arange(width)] += np.sqrt(max(variance.max(), 1e-300))
    vals, vecs = leading_eigenpairs(times, d, k, start)
    comps = np.array([_orient(vecs[:, i]) for i in range(k)])
    total = variance.sum()
    mean[:len(numeric)] = shift
    return EncodedPCA(list(numeric), levels, mean, comps, vals, vals / total if total > 0 else np.zeros(k), n)

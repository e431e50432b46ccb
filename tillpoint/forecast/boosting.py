"""Random search for boosted trees over a small table, one task per candidate.

The aggregated feature table has one row per calendar day, so it is bounded
by the calendar, not by the invoice lines. Its rows meet every (draw, fold)
candidate of the stated search budget by an explode, and each candidate is one
group: Spark runs the 10 × 5 fits side by side, where MLlib would run a few
jobs for each of their ≈15,000 trees. ``models.tune_gbt`` is the MLlib
form for tables that do not fit a task; ``MAX_ROWS`` guards the choice.

Trees: squared loss, at most ``BINS`` value bins per feature, grown level by
level, leaves shrunk by one pseudo-row; rows and columns are drawn per tree.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.forecast.models import N_DRAWS, N_FOLDS, SEARCH_SEED, random_param_draws

BINS = 256
MAX_ROWS = 1_000_000
LEAF_PRIOR = 1.0


def _bin_edges(x: np.ndarray) -> np.ndarray:
    """Inner edges between at most ``BINS`` bins of distinct values."""
    values = np.unique(x)
    if len(values) > BINS:
        values = np.unique(np.quantile(values, np.linspace(0, 1, BINS)))
    return (values[1:] + values[:-1]) / 2


def _grow(codes: np.ndarray, target: np.ndarray, columns: np.ndarray, depth: int) -> list:
    """Levels of a tree as (feature, bin, value) arrays over the 2**level nodes; a feature of -1 passes to the left."""
    node = np.zeros(len(target), np.int64)
    levels = []
    for level in range(depth):
        n = 1 << level
        best = np.full(n, 1e-12)
        feature, split = np.full(n, -1), np.zeros(n, np.int64)
        total, weight = np.bincount(node, target, n), np.bincount(node, minlength=n)
        for f in columns:
            cell = node * BINS + codes[:, f]
            g = np.cumsum(np.bincount(cell, target, n * BINS).reshape(n, BINS), axis=1)
            h = np.cumsum(np.bincount(cell, minlength=n * BINS).reshape(n, BINS), axis=1)
            gr, hr = total[:, None] - g, weight[:, None] - h
            gain = g * g / (h + LEAF_PRIOR) + gr * gr / (hr + LEAF_PRIOR) - (total * total / (weight + LEAF_PRIOR))[:, None]
            gain[(h == 0) | (hr == 0)] = 0
            at = gain.argmax(axis=1)
            top = gain[np.arange(n), at]
            better = top > best
            best[better], feature[better], split[better] = top[better], f, at[better]
        if (feature < 0).all():
            break
        levels.append((feature, split))
        node = _descend(codes, node, feature, split)
    n = 1 << len(levels)
    return [levels, np.bincount(node, target, n) / (np.bincount(node, minlength=n) + LEAF_PRIOR)]


def _descend(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    f = feature[node]
    right = (f >= 0) & (codes[np.arange(len(node)), np.maximum(f, 0)] > split[node])
    return 2 * node + right


def _leaf_values(codes: np.ndarray, tree: list) -> np.ndarray:
    node = np.zeros(len(codes), np.int64)
    for feature, split in tree[0]:
        node = _descend(codes, node, feature, split)
    return tree[1][node]


def boost(x: np.ndarray, y: np.ndarray, others: list[np.ndarray], params: dict, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(predictions for each frame of ``others``, their running predictions are summed tree by tree; the first
    frame's predictions after each tree, as rows)."""
    rng = np.random.default_rng(seed)
    edges = [_bin_edges(x[:, f]) for f in range(x.shape[1])]
    code = lambda z: np.stack([np.searchsorted(e, z[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    codes, theirs = code(x), [code(z) for z in others]
    base = y.mean()
    mine, out = np.full(len(y), base), [np.full(len(z), base) for z in others]
    n_rows = max(1, round(params["subsamplingRate"] * len(y)))
    n_columns = max(1, round(params["colsample"] * x.shape[1]))
    curve = np.zeros((params["maxIter"], len(others[0]) if others else 0))
    for t in range(params["maxIter"]):
        rows = rng.choice(len(y), n_rows, replace=False)
        columns = rng.choice(x.shape[1], n_columns, replace=False)
        tree = _grow(codes[rows], (y - mine)[rows], columns, params["maxDepth"])
        mine += params["stepSize"] * _leaf_values(codes, tree)
        for z, total in zip(theirs, out):
            total += params["stepSize"] * _leaf_values(z, tree)
        if others:
            curve[t] = out[0]
    return out, curve


def _bounded(df: DataFrame) -> None:
    n = df.count()
    if n > MAX_ROWS:
        raise ValueError(f"{n} rows do not fit a task; use models.tune_gbt")


def search(train: DataFrame, features: list[str], target: str, key: str, n_draws: int = N_DRAWS,
           n_folds: int = N_FOLDS, seed: int = SEARCH_SEED) -> DataFrame:
    """``draw, params, cv_mse`` of all draws: mean squared error over ``n_folds`` folds by a seeded hash of ``key``."""
    _bounded(train)
    draws = random_param_draws(n_draws, seed)
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n_folds)).cast("int")
    rows = train.select(F.col(key).cast("string").alias("key"), fold.alias("fold"), F.col(target).cast("double").alias("y"),
                        F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    candidates = F.array(*[F.struct(F.lit(d).alias("draw"), F.lit(k).alias("held")) for d in range(n_draws) for k in range(n_folds)])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        draw, held = int(pdf["draw"].iloc[0]), int(pdf["held"].iloc[0])
        x, y, out = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), (pdf["fold"] == held).to_numpy()
        if out.all() or not out.any():
            return pd.DataFrame({"draw": [], "sse": [], "n": []})
        (guess,), _ = boost(x[~out], y[~out], [x[out]], draws[draw], seed + held)
        return pd.DataFrame({"draw": [draw], "sse": [float(((y[out] - guess) ** 2).sum())], "n": [int(out.sum())]})

    scores = (rows.withColumn("c", F.explode(candidates)).select("key", "fold", "x", "y", "c.draw", "c.held")
                  .groupBy("draw", "held").applyInPandas(fit, "draw int, sse double, n long")
                  .groupBy("draw").agg(F.avg(F.col("sse") / F.col("n")).alias("cv_mse")))
    table = train.sparkSession.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(draws)], "draw int, params string")
    return table.join(scores, "draw").select("draw", "params", "cv_mse")


def best_params(table: DataFrame) -> dict:
    """The draw with the least error (ties: the first)."""
    return json.loads(table.orderBy("cv_mse", "draw").first()["params"])


def fit_predict(data: DataFrame, split_col: str, key: str, models: dict[str, tuple[list[str], str]], params: dict,
                seed: int = SEARCH_SEED) -> DataFrame:
    """Fit each model (name: (features, target)) on the ``train`` rows, one task a model, and predict all others.

    Returns ``key, split, name, actual, prediction, curve``; ``curve`` are the predictions after each tree.
    """
    _bounded(data)
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.col(t).cast("double").alias("y"),
                               F.array(*[F.col(c).cast("double") for c in f]).alias("x")) for n, (f, t) in models.items()])
    rows = data.select(F.col(key).alias("key"), F.col(split_col).alias("split"), F.explode(named).alias("m")) \
               .select("key", "split", "m.*")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x, y, train = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), (pdf["split"] == "train").to_numpy()
        rest = pdf[~train]
        if not train.any() or not len(rest):
            return pd.DataFrame({c: [] for c in ("key", "split", "name", "actual", "prediction", "curve")})
        (guess,), curve = boost(x[train], y[train], [x[~train]], params, seed)
        return pd.DataFrame({"key": rest["key"], "split": rest["split"], "name": rest["name"], "actual": rest["y"],
                             "prediction": guess, "curve": list(curve.T)})

    kind = data.schema[key].dataType.simpleString()
    return rows.groupBy("name").applyInPandas(
        fit, f"key {kind}, split string, name string, actual double, prediction double, curve array<double>")


def validation_curve(predicted: DataFrame, split: str = "val") -> DataFrame:
    """``name, tree, mse`` on the validation rows after each tree."""
    return (predicted.where(F.col("split") == split)
                     .select("name", "actual", F.posexplode("curve").alias("tree", "p"))
                     .groupBy("name", "tree").agg(F.avg((F.col("actual") - F.col("p")) ** 2).alias("mse")))

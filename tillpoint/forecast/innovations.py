"""Innovations of ARMA fits for long series (M2, M3), as a two-level scan over blocks.

``eₜ = uₜ − Σ θⱼ eₜ₋ⱼ`` is a linear recurrence, so a block of consecutive rows
acts on the last Q innovations before it as a Q × Q matrix plus a vector.
First every block finds both on its own; then one small step per series runs
through its blocks (one row each) for their starting values; then every block
filters its rows from there. No task holds more of a series than a block, or
one row a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators.windows import DEFAULT_BLOCK


def run_filter(u: np.ndarray, theta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The recurrence from ``start`` (Q × m, the last row newest): rows of (Q + n) × m, one column a start.
    ``u`` is n × m; a row that is NaN has innovation zero."""
    q, n = len(theta), len(u)
    out = np.vstack([start, np.zeros_like(u)])
    weights = theta[::-1]
    for t in range(n):
        if not np.isnan(u[t]).any():
            out[q + t] = u[t] - weights @ out[t:t + q]
    return out


def innovations(df: DataFrame, theta_col: str, u_col: str, pos_col: str = "pos", keys: list[str] | None = None,
                out_col: str = "e", block: int = DEFAULT_BLOCK) -> DataFrame:
    """``df`` with the innovations of ``u_col`` under the moving-average weights in ``theta_col`` (array, lag 1 first,
    the same on all rows of a series). Before the series they are zero. Where ``u_col`` is null the innovation
    is null and counts as zero in later ones."""
    keys = list(keys or [])
    rows = df.select(*keys, pos_col, F.col(u_col).cast("double").alias("_u"), F.col(theta_col).alias("_theta"),
                     F.floor(F.col(pos_col) / F.lit(block)).cast("long").alias("_blk")).persist(StorageLevel.MEMORY_AND_DISK)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    numbers = T.ArrayType(T.DoubleType())
    at = key_fields + [T.StructField("_blk", T.LongType())]

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values(pos_col)
        return pdf, pdf["_u"].to_numpy(dtype=float), np.asarray(pdf["_theta"].iloc[0], dtype=float)

    def act(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row: the block's vector (Q) and matrix (Q × Q, by rows)."""
        pdf, u, theta = ordered(pdf)
        q = len(theta)
        zero = np.where(np.isnan(u), np.nan, 0.0)[:, None]
        both = run_filter(np.hstack([u[:, None], np.repeat(zero, q, axis=1)]), theta,
                          np.hstack([np.zeros((q, 1)), np.eye(q)]))
        end = both[len(both) - q:]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], pdf["_blk"].iloc[0], end[:, 0].tolist(), end[:, 1:].ravel().tolist()]],
                            columns=[*keys, "_blk", "_r", "_t"])

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        """The starting values of a series' blocks, in order."""
        pdf = pdf.sort_values("_blk")
        state, starts = np.zeros(len(pdf["_r"].iloc[0])), []
        for r, t in zip(pdf["_r"], pdf["_t"]):
            starts.append(state.tolist())
            state = np.asarray(t, dtype=float).reshape(len(state), len(state)) @ state + np.asarray(r, dtype=float)
        return pdf[[*keys, "_blk"]].assign(_start=starts)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, u, theta = ordered(pdf)
        start = np.asarray(pdf["_start"].iloc[0], dtype=float)[:, None]
        e = run_filter(u[:, None], theta, start)[len(theta):, 0]
        return pdf[[*keys, pos_col]].assign(**{out_col: np.where(np.isnan(u), np.nan, e)})

    acts = rows.groupBy(*keys, "_blk").applyInPandas(act, T.StructType(at + [T.StructField("_r", numbers), T.StructField("_t", numbers)]))
    grouped = acts.groupBy(*keys) if keys else acts.groupBy(F.lit(0).alias("_k"))
    starts = grouped.applyInPandas(through, T.StructType(at + [T.StructField("_start", numbers)]))
    done = rows.join(starts, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(
        apply, T.StructType(key_fields + [T.StructField(pos_col, df.schema[pos_col].dataType), T.StructField(out_col, T.DoubleType())]))
    found = done.withColumn(out_col, F.when(~F.isnan(out_col), F.col(out_col)))
    return df.drop(out_col).join(found, [*keys, pos_col])

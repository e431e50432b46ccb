"""Outlier removal (O1 quartile rule, O2 mean ± t·std).

Bounds come from one aggregate pass per step, a single row (two numbers
per column) that is read back and applied as literal predicates. The
returned plan is then a plain filter over the input — no nested copies of
the input's plan, and raw columns get Parquet predicate pushdown. For the
chained mode the input is persisted first, so its k + 1 passes read it once.

``mode``:
  * ``first``   – only the first column is treated (what the original loop does);
  * ``chained`` – column by column, each bound recomputed on the surviving rows
                  (what the loop means to do; default);
  * ``joint``   – all bounds computed on the input, applied together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.session import cut_lineage

MODES = ("first", "chained", "joint")


def _apply(df: DataFrame, bounds: DataFrame, cols: list[str]) -> DataFrame:
    row = bounds.first()
    cond = F.lit(True)
    for c in cols:
        lo, hi = row[f"_lo_{c}"], row[f"_hi_{c}"]
        if lo is None or hi is None:  # no non-missing values: nothing survives
            return df.where(F.lit(False))
        cond = cond & F.col(c).between(F.lit(float(lo)), F.lit(float(hi)))
    return df.where(cond)


def threshold_bounds(df: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    aggs = []
    for c in cols:
        m, s = F.avg(c), F.stddev_samp(c)
        aggs += [(m - F.lit(threshold) * s).alias(f"_lo_{c}"),
                 (m + F.lit(threshold) * s).alias(f"_hi_{c}")]
    return df.agg(*aggs)


def quartile_bounds(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    aggs = []
    for c in cols:
        q1 = F.max(F.when((F.col("column") == c) & (F.col("prob") == 0.25), F.col("value")))
        q3 = F.max(F.when((F.col("column") == c) & (F.col("prob") == 0.75), F.col("value")))
        aggs += [(q1 - F.lit(factor) * (q3 - q1)).alias(f"_lo_{c}"),
                 (q3 + F.lit(factor) * (q3 - q1)).alias(f"_hi_{c}")]
    return q.agg(*aggs)


def _remove(df: DataFrame, cols: list[str], mode: str, bounds_fn,
            materialize: str = "persist") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    cols = list(cols)
    if not cols:
        return df
    if mode == "first":
        return _apply(df, bounds_fn(df, cols[:1]), cols[:1])
    if mode == "joint":
        return _apply(df, bounds_fn(df, cols), cols)
    base = cut_lineage(df, materialize) if len(cols) > 1 else df
    out = base
    for c in cols:
        out = _apply(out, bounds_fn(out, [c]), [c])
    return out


def remove_by_threshold(df: DataFrame, cols, threshold: float = 20.0,
                        mode: str = "chained") -> DataFrame:
    """O2: keep mean − t·s ≤ x ≤ mean + t·s (sample std)."""
    return _remove(df, cols, mode, lambda d, cs: threshold_bounds(d, cs, threshold))


def remove_by_quartiles(df: DataFrame, cols, factor: float = 1.5,
                        mode: str = "chained") -> DataFrame:
    """O1: keep Q1 − f·IQR ≤ x ≤ Q3 + f·IQR with exact interpolated quartiles."""
    return _remove(df, cols, mode, lambda d, cs: quartile_bounds(d, cs, factor))

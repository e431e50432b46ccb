"""Exact scalers (T1–T4), optionally per group (e.g. per batch).

MLlib's ``StandardScaler`` divides by the *sample* std and its
``MinMaxScaler`` maps a constant column to 0.5; the reference's scalers use
the population std and map a constant column to 0. So the parameters are
computed with plain aggregates:

* fitted parameters are a small DataFrame — one row, or one row per group;
* applying them is a join (one-row parameters: broadcast cross join whose
  size is fixed; per-group parameters: materialised, so that their measured
  size tells whether they can be broadcast and the rows stay where they are)
  followed by column arithmetic, all inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.session import cut_lineage

KINDS = ("standard", "minmax", "robust")


def _safe(scale):
    """A zero (or undefined) spread divides by 1, as the reference's scalers do."""
    return F.when(scale.isNull() | (scale == 0), F.lit(1.0)).otherwise(scale)


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard",
               keys: list[str] | None = None) -> DataFrame:
    """Parameters ``keys…, {c}_center, {c}_scale`` for each column."""
    keys = list(keys or [])
    if kind == "standard":
        aggs = []
        for c in cols:
            aggs += [F.avg(c).alias(f"{c}_center"), _safe(F.stddev_pop(c)).alias(f"{c}_scale")]
        return df.groupBy(*keys).agg(*aggs)
    if kind == "minmax":
        aggs = []
        for c in cols:
            aggs += [F.min(c).cast("double").alias(f"{c}_center"),
                     _safe((F.max(c) - F.min(c)).cast("double")).alias(f"{c}_scale")]
        return df.groupBy(*keys).agg(*aggs)
    if kind == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], group_cols=keys)
        aggs = []
        for c in cols:
            pick = lambda p: F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value")))
            aggs += [pick(0.5).alias(f"{c}_center"), _safe(pick(0.75) - pick(0.25)).alias(f"{c}_scale")]
        return q.groupBy(*keys).agg(*aggs)
    raise ValueError(f"kind must be one of {KINDS}")


def scaled_value(c: str) -> Column:
    """(x − center) / scale of a row that the parameters are joined to."""
    return (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale")


def _join(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return df.join(params, keys, "left")
    return df.crossJoin(F.broadcast(params))


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str],
                 keys: list[str] | None = None, suffix: str = "") -> DataFrame:
    """(x − center) / scale; ``suffix=''`` replaces the columns in place."""
    keys = list(keys or [])
    j = _join(df, params, keys)
    j = j.withColumns({f"{c}{suffix}": scaled_value(c) for c in cols})
    return j.drop(*[f"{c}_{p}" for c in cols for p in ("center", "scale")])


def inverse_scaler(df: DataFrame, params: DataFrame, cols: list[str],
                   keys: list[str] | None = None, suffix: str = "") -> DataFrame:
    """T4: x·scale + center."""
    keys = list(keys or [])
    j = _join(df, params, keys)
    j = j.withColumns({f"{c}{suffix}": F.col(c) * F.col(f"{c}_scale") + F.col(f"{c}_center")
                       for c in cols})
    return j.drop(*[f"{c}_{p}" for c in cols for p in ("center", "scale")])


def with_parameters(df: DataFrame, cols: list[str], kind: str, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the parameters of its own fit per ``keys`` beside each row, and their columns' names: ``scaled_value``
    is computed from them where it is needed."""
    params = cut_lineage(fit_scaler(df, cols, kind, keys), "persist")
    # one row for many of ``df``: sent to its rows also where it is a little over the threshold, which would move all rows
    return _join(df, F.broadcast(params), keys), [c for c in params.columns if c not in keys]


def scale(df: DataFrame, cols: list[str], kind: str = "standard",
          keys: list[str] | None = None, fit_on: DataFrame | None = None,
          suffix: str = "") -> DataFrame:
    """Fit on ``fit_on`` (default: ``df`` itself) and apply to ``df``."""
    params = fit_scaler(fit_on if fit_on is not None else df, cols, kind, keys)
    if keys:
        params = cut_lineage(params, "persist")
    return apply_scaler(df, params, cols, keys, suffix)

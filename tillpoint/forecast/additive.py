"""Additive trend + seasonality forecast (M1, C7), many series at once.

The per-series solver of the original is re-aimed as a linear model on
features built in Spark:

* trend: scaled time t ∈ [0, 1] over the training span, plus hinge terms
  (t − sⱼ)₊ at ``n_changepoints`` points spread over the first 80 % of the
  training span (a piecewise-linear trend, ridge-penalised);
* weekly seasonality: Fourier terms of order 3 (period 7 days);
* yearly seasonality: Fourier terms of order 10 (period 365.25 days):
  ``yearly`` True, False, or 'auto' (each series whose training span covers
  ``YEARLY_DAYS`` days).

Coefficients per series come from grouped normal equations
(``forecast.linear``); forecasts are column expressions. The interval is
yhat ± z·σ of the training residuals (80 %: z = 1.2816).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.forecast.linear import fit_least_squares, linear_prediction
from tillpoint.session import cut_lineage

Z80 = 1.2815515655446004
YEARLY_DAYS = 730  # two years


def _features(df: DataFrame, date_col: str, span: DataFrame, keys: list[str],
              n_cp: int, weekly: int, yearly: int) -> tuple[DataFrame, list[str], dict]:
    j = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))
    days = F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")).cast("double")
    t = (F.datediff(F.col(date_col), F.col("_start")) / F.greatest(F.col("_len"), F.lit(1))).cast("double")
    cols = {"t": t}
    groups = {"trend": ["t"], "weekly": [], "yearly": []}
    for i in range(n_cp):
        s = 0.8 * (i + 1) / (n_cp + 1)
        cols[f"cp{i}"] = F.greatest(t - F.lit(s), F.lit(0.0))
        groups["trend"].append(f"cp{i}")
    for k in range(1, weekly + 1):
        for fn, nm in ((F.sin, "ws"), (F.cos, "wc")):
            cols[f"{nm}{k}"] = fn(days * F.lit(2 * math.pi * k / 7.0))
            groups["weekly"].append(f"{nm}{k}")
    for k in range(1, yearly + 1):
        for fn, nm in ((F.sin, "ys"), (F.cos, "yc")):
            # multiplied by the flag so a short training span drops the yearly terms
            cols[f"{nm}{k}"] = fn(days * F.lit(2 * math.pi * k / 365.25)) * F.col("_yearly")
            groups["yearly"].append(f"{nm}{k}")
    feats = [c for g in groups.values() for c in g]
    return j.withColumns(cols), feats, groups


def additive_forecast(df: DataFrame, date_col: str = "Date", value_col: str = "Sales",
                      split_col: str = "split", keys: list[str] | None = None,
                      n_changepoints: int = 25, weekly_order: int = 3, yearly_order: int = 10,
                      ridge: float = 1e-3, yearly: bool | str = "auto") -> DataFrame:
    """Fit on rows with ``split = 'train'``; return every row with ``yhat``,
    ``trend``, ``weekly``, ``yearly``, ``yhat_lower``, ``yhat_upper``."""
    keys = list(keys or [])
    # the aggregated series is small (days × series) and used several times
    df = cut_lineage(df, "persist")
    train = df.where(F.col(split_col) == "train")
    span = train.groupBy(*keys).agg(F.min(date_col).alias("_start"), F.max(date_col).alias("_end")) \
                .withColumn("_len", F.datediff("_end", "_start")) \
                .withColumn("_yearly", (F.col("_len") >= YEARLY_DAYS if yearly == "auto" else F.lit(bool(yearly))).cast("double"))
    feat_df, feats, groups = _features(df, date_col, span, keys, n_changepoints, weekly_order, yearly_order)
    coefs = cut_lineage(fit_least_squares(feat_df.where(F.col(split_col) == "train"), feats, value_col,
                                          keys, ridge=ridge, penalise=[c for c in feats if c != "t"]),
                        "persist")
    j = feat_df.join(coefs, keys) if keys else feat_df.crossJoin(F.broadcast(coefs))

    def part(names: list[str]):
        e = F.lit(0.0)
        for c in names:
            e = e + F.col("coef")[1 + feats.index(c)] * F.col(c)
        return e

    out = j.withColumns({"trend": F.col("coef")[0] + part(groups["trend"]),
                         "weekly": part(groups["weekly"]), "yearly": part(groups["yearly"])})
    out = out.withColumn("yhat", linear_prediction(feats))
    resid = (out.where(F.col(split_col) == "train")
                .groupBy(*keys).agg(F.stddev_samp(F.col(value_col) - F.col("yhat")).alias("_sd")))
    out = out.join(resid, keys) if keys else out.crossJoin(F.broadcast(resid))
    out = out.withColumns({"yhat_lower": F.col("yhat") - F.lit(Z80) * F.col("_sd"),
                           "yhat_upper": F.col("yhat") + F.lit(Z80) * F.col("_sd")})
    return out.select(*keys, date_col, split_col, value_col, "yhat", "trend", "weekly", "yearly",
                      "yhat_lower", "yhat_upper")

"""ARIMA(p, 1, q) and SARIMAX forecasts (M2, M3, W4) for many series.

The exact-likelihood solver of the original is re-aimed as the two-stage
Hannan–Rissanen regression, all fits by grouped normal equations:

1. with regressors (SARIMAX): their coefficients come from the differenced
   values on the differenced regressors; what they do not explain is the
   noise series of the next stages (a regression with ARIMA errors);
2. difference the noise once, with ``season`` also by its value a season
   before, and fit a long AR(m) on the lags;
3. its residuals stand in for the innovations; regress the differences on
   their lags 1 … p and the residuals' lags 1 … q, and with ``season = s``
   on lags s, 2s … of both (the unconstrained form of the seasonal product);
4. forecast recursively: only the last observations of each series take
   part, in a small pandas step per series key; a regressor's part is added
   from the test rows.

One range exchange numbers train and test rows together. Lags are window
columns computed block-wise with a halo (no single partition). Forecast step
k is paired with the k-th test observation by date (B4), not by position of
the split day.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.forecast.linear import fit_least_squares, predict
from tillpoint.operators.rowindex import with_row_index
from tillpoint.operators.windows import DEFAULT_BLOCK, lag_columns
from tillpoint.session import cut_lineage


def _shrinkage(phi: np.ndarray) -> float:
    """The factor s ≤ 1 with which φᵢsⁱ is stable: it divides the roots of 1 − Σφᵢzⁱ, which must lie outside
    the unit circle."""
    roots = np.abs(np.roots(np.r_[-phi[::-1], 1.0])) if len(phi) else np.zeros(0)
    least = roots.min() if len(roots) else np.inf
    return 1.0 if least > 1.0 + 1e-6 else float(least / 1.001)


def difference(df: DataFrame, value_col: str, pos_col: str, keys: list[str], season: int = 0,
               out_col: str = "dy", block: int = DEFAULT_BLOCK) -> DataFrame:
    """First difference of ``value_col``; with ``season`` also differenced by ``season`` rows (null where a term is)."""
    lags = [1, season, season + 1] if season else [1]
    out = lag_columns(df, value_col, sorted(set(lags)), pos_col, keys, block=block, diff=False, prefix="_d")
    d = F.col(value_col) - F.col("_d_1")
    if season:
        d = d - F.col(f"_d_{season}") + F.col(f"_d_{season + 1}")
    return out.withColumn(out_col, d).drop(*[f"_d_{i}" for i in set(lags)])


def lag_design(df: DataFrame, value_col: str, pos_col: str, keys: list[str], lags: list[int],
               season: int = 0, block: int = DEFAULT_BLOCK) -> DataFrame:
    """The regressions' design: ``dy`` (``difference``) and its lags ``l_i``, null before the series' start."""
    return lag_columns(difference(df, value_col, pos_col, keys, season, block=block), "dy", lags, pos_col, keys,
                       block=block, diff=False, prefix="l")


def numbered(df: DataFrame, date_col: str, split_col: str, keys: list[str]) -> DataFrame:
    """Train and test rows numbered together, by one range exchange: ``pos`` in the series, train rows first, and
    ``step`` (null on train rows) from the first test row."""
    rows = df.where(F.col(split_col).isin("train", "test")).withColumn("_side", (F.col(split_col) != "train").cast("int"))
    rows = with_row_index(rows, [*keys, "_side", date_col], col="_ix")
    ends = rows.groupBy(*keys).agg(F.min("_ix").alias("_i0"), F.min(F.when(F.col("_side") == 1, F.col("_ix"))).alias("_i1"))
    rows = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))
    return rows.withColumns({"pos": (F.col("_ix") - F.col("_i0")).cast("int"),
                             "step": F.when(F.col("_side") == 1, F.col("_ix") - F.col("_i1")).cast("int")}
                            ).drop("_ix", "_i0", "_i1", "_side")


def arima_forecast(df: DataFrame, date_col: str = "Date", value_col: str = "Sales",
                   split_col: str = "split", keys: list[str] | None = None,
                   p: int = 12, q: int = 12, long_ar: int | None = None,
                   ridge: float = 1e-4, stabilise: bool = True, season: int = 0,
                   seasonal_lags: int = 1, exog: list[str] | None = None) -> DataFrame:
    """Fit on ``split = 'train'`` rows, forecast every ``test`` row.

    Returns ``keys…, date, step, actual, forecast, shrinkage``. With
    ``stabilise`` an explosive fit is used with coefficients φᵢsⁱ;
    ``shrinkage`` is s, 1 for the fit as it is. ``season`` > 1 adds the seasonal
    difference and ``seasonal_lags`` seasonal lags of both kinds; ``exog`` names
    regressor columns, known on the test rows too (a null there gives a null
    forecast; a train row with a null one takes no part in the fits).
    A series with too few rows for a complete regression row has no forecast.
    """
    keys, exog = list(keys or []), list(exog or [])
    if season in (1,) or season < 0:
        raise ValueError("season must be 0 or at least 2")
    seasonal = [season * i for i in range(1, seasonal_lags + 1)] if season else []
    ar, ma = sorted({*range(1, p + 1), *seasonal}), sorted({*range(1, q + 1), *seasonal})
    m = long_ar or max([*ar, *ma, 1]) * 2
    m = max([m, *ar])
    # the aggregated series is small (days × series) and used several times; what each stage makes of it is checkpointed,
    # so that no later job goes through the plans of the earlier ones again
    rows = cut_lineage(numbered(df.select(*keys, date_col, split_col, value_col, *exog), date_col, split_col, keys),
                       "checkpoint")
    train, test = rows.where(F.col("step").isNull()), rows.where(F.col("step").isNotNull())
    train = train.withColumn("_noise", F.col(value_col).cast("double"))
    test = test.withColumn("_part", F.lit(0.0))
    if exog:
        moved = difference(train, value_col, "pos", keys, season, "_dv")
        for i, x in enumerate(exog):
            moved = difference(moved, x, "pos", keys, season, f"_dx{i}")
        beta = cut_lineage(fit_least_squares(moved, [f"_dx{i}" for i in range(len(exog))], "_dv", keys, ridge=1e-9)
                           .select(*keys, F.col("coef").alias("_beta")), "checkpoint")
        part = sum((F.col("_beta")[i + 1] * F.col(x) for i, x in enumerate(exog)), F.lit(0.0))

        def with_beta(d: DataFrame) -> DataFrame:
            return d.join(beta, keys) if keys else d.crossJoin(F.broadcast(beta))
        train = with_beta(train).withColumn("_noise", F.col(value_col) - part).drop("_beta")
        test = with_beta(test).withColumn("_part", part).drop("_beta")
    train = train.select(*keys, "pos", "_noise")
    lagged = cut_lineage(lag_design(train, "_noise", "pos", keys, list(range(1, m + 1)), season), "checkpoint")
    ar_feats = [f"l_{i}" for i in range(1, m + 1)]
    c1 = cut_lineage(fit_least_squares(lagged, ar_feats, "dy", keys, ridge=ridge), "checkpoint")
    res = predict(lagged, c1, ar_feats, keys, "_fit").withColumn("e", F.col("dy") - F.col("_fit")).drop("_fit")
    feats2 = [f"l_{i}" for i in ar] + [f"el_{j}" for j in ma]
    res = cut_lineage(lag_columns(res, "e", ma, "pos", keys, diff=False, prefix="el"), "checkpoint")
    c2 = cut_lineage(fit_least_squares(res, feats2, "dy", keys, ridge=ridge), "checkpoint")

    # tails: last observations per series, for the recursion
    tail_n = max([*ar, *ma, m, season]) + 1
    last = res.groupBy(*keys).agg(F.max("pos").alias("_last"))
    tail = ((res.join(last, keys) if keys else res.crossJoin(F.broadcast(last)))
            .where(F.col("pos") > F.col("_last") - tail_n).select(*keys, "pos", "_noise", "dy", "e"))
    horizon = test.groupBy(*keys).agg(F.max("step").alias("_h"))
    pack = (tail.join(c2.drop("n"), keys).join(horizon, keys)) if keys else \
        tail.crossJoin(F.broadcast(c2.drop("n"))).crossJoin(F.broadcast(horizon))
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("step", T.IntegerType()),
                                        T.StructField("_noise", T.DoubleType()),
                                        T.StructField("shrinkage", T.DoubleType())])

    def recurse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        coef = np.asarray(pdf["coef"].iloc[0], dtype=float)
        c, phi, theta = coef[0], np.zeros(max([*ar, 0])), coef[1 + len(ar):]
        phi[np.array(ar, dtype=int) - 1] = coef[1:1 + len(ar)]
        shrink = _shrinkage(phi) if stabilise else 1.0
        phi = phi * shrink ** np.arange(1, len(phi) + 1)
        dy, e = list(pdf["dy"].fillna(0.0)), list(pdf["e"].fillna(0.0))
        level, known = list(pdf["_noise"]), len(pdf)
        for _ in range(0 if pd.isna(pdf["_h"].iloc[0]) else int(pdf["_h"].iloc[0]) + 1):
            step = c + sum(phi[i - 1] * dy[-i] for i in ar if i <= len(dy)) \
                + sum(t * e[-j] for t, j in zip(theta, ma) if j <= len(e))
            dy.append(step)
            e.append(0.0)
            level.append(step + level[-1] + (level[-season] - level[-season - 1] if season else 0.0))
        out = pd.DataFrame({"step": range(len(level) - known), "_noise": level[known:]})
        return out.assign(shrinkage=shrink, **{k: pdf[k].iloc[0] for k in keys})[[*keys, "step", "_noise", "shrinkage"]]

    grouped = pack.groupBy(*keys) if keys else pack.withColumn("_k", F.lit(0)).groupBy("_k")
    fc = grouped.applyInPandas(recurse, schema)
    return (test.join(fc, keys + ["step"])
                .select(*keys, date_col, "step", F.col(value_col).alias("actual"),
                        (F.col("_noise") + F.col("_part")).alias("forecast"), "shrinkage"))

"""Error metrics (M9–M12) and forecast/actual pairing.

Each metric set is one aggregate pass (partial aggregation per partition),
optionally per series key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.numeric import MAPE_EPSILON, guarded_abs


def pair_with_actuals(pred: DataFrame, actual: DataFrame, on: list[str],
                      how: str = "inner") -> DataFrame:
    """Forecasts meet actuals by date (and series key), not by position."""
    return pred.join(actual, on, how)


def regression_metrics(df: DataFrame, target: str, pred: str,
                       keys: list[str] | None = None) -> DataFrame:
    """M9: MSE, RMSE, MAE, R² (R² = 1 − SSres / SStot)."""
    keys = list(keys or [])
    err = F.col(target) - F.col(pred)
    g = df.groupBy(*keys).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_ssr"),
        (F.var_pop(target) * F.count(target)).alias("_sst"))
    return g.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae",
                    (F.lit(1.0) - F.try_divide(F.col("_ssr"), F.col("_sst"))).alias("r2"))


def rmse_mae_mape(df: DataFrame, actual: str, pred: str,
                  keys: list[str] | None = None) -> DataFrame:
    """RMSE (printed as "Mean Squared Error" in the original, B14), MAE,
    MAPE in percent without a guard (B15): rows with a zero actual give no
    ratio and are counted in ``mape_skipped``."""
    keys = list(keys or [])
    err = F.col(actual) - F.col(pred)
    ratio = F.abs(F.try_divide(err, F.col(actual)))
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (F.avg(ratio) * 100).alias("mape"),
        F.count_if(ratio.isNull()).alias("mape_skipped"))


def rmse_mae_mape_guarded(df: DataFrame, actual: str, pred: str, eps: float = MAPE_EPSILON,
                          keys: list[str] | None = None) -> DataFrame:
    """MAPE with denominator max(|y|, 1e-10), RMSE, MAE."""
    keys = list(keys or [])
    err = F.col(actual) - F.col(pred)
    return df.groupBy(*keys).agg(
        (F.avg(F.abs(err) / guarded_abs(F.col(actual), eps)) * 100).alias("mape"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"))


def row_errors(df: DataFrame, actual: str, pred: str, eps: float = MAPE_EPSILON) -> DataFrame:
    """Per-row APE (%), squared error, absolute error."""
    err = F.col(actual) - F.col(pred)
    return df.withColumns({
        "ape": F.abs(err) / guarded_abs(F.col(actual), eps) * 100,
        "squared_error": err * err,
        "absolute_error": F.abs(err)})

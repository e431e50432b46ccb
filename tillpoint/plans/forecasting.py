"""Registered queries: splits, metrics, forecasts (§2.11, C4–C9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.forecast import metrics as mt
from tillpoint.forecast.additive import additive_forecast
from tillpoint.forecast.autoregressive import arima_forecast, lag_design, numbered
from tillpoint.forecast.models import sequence_regression
from tillpoint.forecast.split import random_holdout, split_at_date, split_timestamp_ranges
from tillpoint.operators import aggregates as agg
from tillpoint.operators import scale as sc
from tillpoint.operators import windows as win
from tillpoint.operators.rowindex import with_row_index
from tillpoint.plans.cleaning import cleaned_lines, cleaned_sales, daily_cleaned
from tillpoint.plans.common import CLEAN_CTES, r, rounded, with_sales
from tillpoint.plans.registry import query
from tillpoint.plans.transforms import SPLIT_DATE, TEST_RANGE, TRAIN_RANGE
from tillpoint.session import cut_lineage
from tillpoint.sources.sales import ORDER_KEYS

_DAILY = "d AS (SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales FROM clean GROUP BY 1)"
SEASON = 7


def daily_split(spark, sf_dir, overlap: bool = False):
    """The daily series, summed once: both sides of the split, and whatever reads them, take the few summed rows."""
    return split_at_date(cut_lineage(daily_cleaned(spark, sf_dir)), "Date", SPLIT_DATE, overlap)


@query("split_series", with_sales(*CLEAN_CTES, _DAILY) + f"""
SELECT Date, Sales, 'train' AS split FROM d WHERE Date <= DATE '{SPLIT_DATE}'
UNION ALL SELECT Date, Sales, 'test' AS split FROM d WHERE Date > DATE '{SPLIT_DATE}'""")
def q_split_series(spark, sf_dir):
    """Daily series with train/test labels (split day in train only)."""
    return daily_split(spark, sf_dir)


@query("split_series_overlap", with_sales(*CLEAN_CTES, _DAILY) + f"""
SELECT Date, Sales, 'train' AS split FROM d WHERE Date <= DATE '{SPLIT_DATE}'
UNION ALL SELECT Date, Sales, 'test' AS split FROM d WHERE Date >= DATE '{SPLIT_DATE}'""")
def q_split_series_overlap(spark, sf_dir):
    """F9 with ``overlap=True``: the split day in both sets, as the original."""
    return daily_split(spark, sf_dir, overlap=True)


def naive_pairs(spark, sf_dir):
    """J4 with a seasonal-naive forecast (the value 7 observations earlier),
    paired with the actual by date on the test side."""
    s = daily_split(spark, sf_dir)
    pos = win.add_position(s.select("Date", "Sales", "split"), "Date", [], "pos")
    lagged = win.lag_columns(pos, "Sales", [SEASON], "pos", diff=False, prefix="lag", block=500)
    pred = lagged.where("split = 'test'").select("Date", F.col(f"lag_{SEASON}").alias("forecast"))
    actual = s.where("split = 'test'").select("Date", F.col("Sales").alias("actual"))
    return mt.pair_with_actuals(pred, actual, ["Date"])


_NAIVE = with_sales(*CLEAN_CTES, _DAILY,
    "p AS (SELECT Date, Sales, lag(Sales, 7) OVER (ORDER BY Date) AS forecast FROM d)",
    f"pr AS (SELECT Date, Sales AS actual, forecast FROM p WHERE Date > DATE '{SPLIT_DATE}')")


@query("metrics_regression_naive", _NAIVE + f"""
SELECT {r('avg((actual - forecast) ^ 2)', 2)} AS mse, {r('sqrt(avg((actual - forecast) ^ 2))', 4)} AS rmse,
  {r('avg(abs(actual - forecast))', 4)} AS mae,
  {r('1 - sum((actual - forecast) ^ 2) / (var_pop(actual) * count(actual))')} AS r2 FROM pr""")
def q_metrics_regression_naive(spark, sf_dir):
    """M9 (MSE, RMSE, MAE, R²) of the seasonal-naive forecast on the test days."""
    m = mt.regression_metrics(naive_pairs(spark, sf_dir), "actual", "forecast")
    return m.select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"),
                    F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("metrics_mape_naive", _NAIVE + f"""
SELECT {r('sqrt(avg((actual - forecast) ^ 2))', 4)} AS rmse, {r('avg(abs(actual - forecast))', 4)} AS mae,
  {r('avg(abs((actual - forecast) / nullif(actual, 0))) * 100')} AS mape,
  count_if((actual - forecast) / nullif(actual, 0) IS NULL)::BIGINT AS mape_skipped FROM pr""")
def q_metrics_mape_naive(spark, sf_dir):
    """RMSE, MAE, unguarded MAPE (zero actuals skipped and counted)."""
    m = mt.rmse_mae_mape(naive_pairs(spark, sf_dir), "actual", "forecast")
    return m.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                    F.round("mape", 6).alias("mape"), "mape_skipped")


@query("metrics_guarded_naive", _NAIVE + f"""
SELECT {r('avg(abs(actual - forecast) / greatest(abs(actual), 1e-10)) * 100')} AS mape,
  {r('sqrt(avg((actual - forecast) ^ 2))', 4)} AS rmse, {r('avg(abs(actual - forecast))', 4)} AS mae FROM pr""")
def q_metrics_guarded_naive(spark, sf_dir):
    """MAPE with the 1e-10 guard, RMSE, MAE."""
    m = mt.rmse_mae_mape_guarded(naive_pairs(spark, sf_dir), "actual", "forecast")
    return m.select(F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"),
                    F.round("mae", 4).alias("mae"))


@query("row_errors_naive", _NAIVE + f"""
SELECT Date, actual, forecast, {r('abs(actual - forecast) / greatest(abs(actual), 1e-10) * 100')} AS ape,
  {r('(actual - forecast) ^ 2', 2)} AS squared_error, {r('abs(actual - forecast)', 2)} AS absolute_error
FROM pr""")
def q_row_errors_naive(spark, sf_dir):
    """Per-day APE, squared and absolute error."""
    e = mt.row_errors(naive_pairs(spark, sf_dir), "actual", "forecast")
    return e.select("Date", "actual", "forecast", F.round("ape", 6).alias("ape"),
                    F.round("squared_error", 2).alias("squared_error"),
                    F.round("absolute_error", 2).alias("absolute_error"))


@query("holdout_sizes", with_sales(*CLEAN_CTES) + f"""
SELECT 'val' AS split, CAST(ceil(0.2 * count(*)) AS BIGINT) AS rows FROM clean
  WHERE InvoiceDate >= TIMESTAMP '{TRAIN_RANGE[0]}' AND InvoiceDate < TIMESTAMP '{TRAIN_RANGE[1]}' + INTERVAL 1 DAY
UNION ALL
SELECT 'train', count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) FROM clean
  WHERE InvoiceDate >= TIMESTAMP '{TRAIN_RANGE[0]}' AND InvoiceDate < TIMESTAMP '{TRAIN_RANGE[1]}' + INTERVAL 1 DAY""")
def q_holdout_sizes(spark, sf_dir):
    """M8 + P5: seeded 80/20 hold-out of the training lines — exactly
    ceil(20 %) rows go to validation, independent of partitioning."""
    clean = cleaned_lines(spark, sf_dir, ["InvoiceNo", *ORDER_KEYS])
    tr = split_timestamp_ranges(clean, "InvoiceDate", TRAIN_RANGE, TEST_RANGE).where("split = 'train'")
    h = random_holdout(tr.drop("split"), ["InvoiceNo", "l_partkey", "l_suppkey", "l_linenumber",
                                          "l_extendedprice", "l_shipdate"])
    return h.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def scaled_split(spark, sf_dir):
    """Daily series, split, robust scaling fitted on train (B5 fixed). The daily rows, read many times, are cut first."""
    s = cut_lineage(daily_split(spark, sf_dir))
    params = sc.fit_scaler(s.where("split = 'train'"), ["Sales"], "robust")
    return sc.apply_scaler(s, params, ["Sales"])


@query("additive_forecast")
def q_additive_forecast(spark, sf_dir):
    """Trend + weekly (+ yearly) forecast with components and 80 % band."""
    return additive_forecast(scaled_split(spark, sf_dir), "Date", "Sales", "split")


@query("additive_metrics")
def q_additive_metrics(spark, sf_dir):
    """M1 + M10 on the test days."""
    f = additive_forecast(scaled_split(spark, sf_dir), "Date", "Sales", "split").where("split = 'test'")
    return mt.rmse_mae_mape(f, "Sales", "yhat")


@query("arima_forecast")
def q_arima_forecast(spark, sf_dir):
    """ARIMA(12, 1, 12) by two-stage regression, forecast over the test days."""
    return arima_forecast(scaled_split(spark, sf_dir), "Date", "Sales", "split", p=12, q=12)


@query("arima_metrics")
def q_arima_metrics(spark, sf_dir):
    """M2 + M10."""
    return mt.rmse_mae_mape(arima_forecast(scaled_split(spark, sf_dir), p=12, q=12), "actual", "forecast")


@query("sarimax_forecast")
def q_sarimax_forecast(spark, sf_dir):
    """M3: the same (12, 1, 12) order with no seasonal order and no exogenous
    columns, as configured in the original — identical model to M2."""
    return arima_forecast(scaled_split(spark, sf_dir), "Date", "Sales", "split", p=12, q=12)


def _design_sql(season: int) -> str:
    dy = "v - l1" + (" - ls + lt" if season else "")
    more = f", lag(Sales, {season}) OVER (ORDER BY Date) AS ls, lag(Sales, {season + 1}) OVER (ORDER BY Date) AS lt" if season else ""
    return with_sales(*CLEAN_CTES, _DAILY,
        f"w AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS pos, Sales AS v, lag(Sales, 1) OVER (ORDER BY Date) AS l1{more} "
        f"FROM d WHERE Date <= DATE '{SPLIT_DATE}')",
        f"z AS (SELECT Date, CAST(pos AS INTEGER) AS pos, {dy} AS dy FROM w)") + \
        f"SELECT Date, pos, {r('dy', 2)} + 0.0 AS dy, " + ", ".join(
            f"{r(f'lag(dy, {i}) OVER (ORDER BY pos)', 2)} + 0.0 AS l_{i}" for i in DESIGN_LAGS) + " FROM z"


DESIGN_LAGS = list(range(1, 13))


def _lag_design(spark, sf_dir, season: int):
    rows = numbered(daily_split(spark, sf_dir), "Date", "split", []).where("split = 'train'")
    out = lag_design(rows.select("Date", "pos", "Sales"), "Sales", "pos", [], DESIGN_LAGS, season)
    return out.select("Date", "pos", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ["dy"] + [f"l_{i}" for i in DESIGN_LAGS]])


@query("arima_design", _design_sql(0))
def q_arima_design(spark, sf_dir):
    """M2/W4, exact part: the differenced train series and its 12 lags, the regression's design."""
    return _lag_design(spark, sf_dir, 0)


@query("sarimax_design", _design_sql(SEASON))
def q_sarimax_design(spark, sf_dir):
    """M3/W4, exact part: differenced by one and by a season of 7 observations, with 12 lags."""
    return _lag_design(spark, sf_dir, SEASON)


def _sarimax_weekly(spark, sf_dir):
    s = scaled_split(spark, sf_dir).withColumn("first_week", (F.dayofmonth("Date") <= 7).cast("double"))
    return arima_forecast(s, "Date", "Sales", "split", p=12, q=12, season=SEASON, exog=["first_week"])


@query("sarimax_weekly_forecast")
def q_sarimax_weekly_forecast(spark, sf_dir):
    """M3 with its seasonal and exogenous terms: a season of 7 observations, the first week of a month as regressor."""
    return _sarimax_weekly(spark, sf_dir)


@query("sarimax_weekly_metrics")
def q_sarimax_weekly_metrics(spark, sf_dir):
    """M3 with its terms + M10."""
    return mt.rmse_mae_mape(_sarimax_weekly(spark, sf_dir), "actual", "forecast")


def _sequences(spark, sf_dir, grain: str = "day", length: int = 30):
    """M4 input: min-max (fitted on train) sales, windows of the ``length`` values before each target.

    ``grain='day'``: one value a day. ``grain='line'``: one value an invoice line (B13), in order of the row
    keys. The first test targets have the train tail as context.
    """
    from tillpoint.forecast.split import split_date_ranges
    if grain == "day":
        series = daily_cleaned(spark, sf_dir)
        placed = win.add_position(series, "Date", [], "pos")
    elif grain == "line":
        clean = cleaned_lines(spark, sf_dir, [*ORDER_KEYS, "Quantity", "UnitPrice"])
        series = clean.select(*ORDER_KEYS, F.to_date("InvoiceDate").alias("Date"),
                              (F.col("Quantity") * F.col("UnitPrice")).alias("Sales"))
        placed = with_row_index(series, ORDER_KEYS, col="pos")
    else:
        raise ValueError("grain must be 'day' or 'line'")
    sp = split_date_ranges(placed, "Date", TRAIN_RANGE, TEST_RANGE)
    params = sc.fit_scaler(sp.where("split = 'train'"), ["Sales"], "minmax")
    return win.sliding_sequences(sc.apply_scaler(sp, params, ["Sales"]), "Sales", length, "pos"), params


@query("sequences_split_sizes", with_sales(*CLEAN_CTES, _DAILY,
    f"""sp AS (SELECT Date, CASE WHEN Date BETWEEN DATE '{TRAIN_RANGE[0]}' AND DATE '{TRAIN_RANGE[1]}' THEN 'train'
         WHEN Date BETWEEN DATE '{TEST_RANGE[0]}' AND DATE '{TEST_RANGE[1]}' THEN 'test' END AS split FROM d)""",
    f"""ln AS (SELECT CASE WHEN CAST(InvoiceDate AS DATE) BETWEEN DATE '{TRAIN_RANGE[0]}' AND DATE '{TRAIN_RANGE[1]}' THEN 'train'
         WHEN CAST(InvoiceDate AS DATE) BETWEEN DATE '{TEST_RANGE[0]}' AND DATE '{TEST_RANGE[1]}' THEN 'test' END AS split FROM clean)""")
    + """SELECT 'day' AS grain, split, count(*) - CASE WHEN split = 'train' THEN 30 ELSE 0 END AS sequences
FROM sp WHERE split IS NOT NULL GROUP BY split
UNION ALL SELECT 'line', split, count(*) - CASE WHEN split = 'train' THEN 30 ELSE 0 END FROM ln WHERE split IS NOT NULL GROUP BY split""")
def q_sequences_split_sizes(spark, sf_dir):
    """Windows per side at both grains; only the series' first 30 values have none."""
    out = None
    for grain in ("day", "line"):
        g = _sequences(spark, sf_dir, grain)[0].groupBy("split").agg(F.count(F.lit(1)).alias("sequences")) \
                                             .select(F.lit(grain).alias("grain"), "split", "sequences")
        out = g if out is None else out.unionByName(g)
    return out


@query("sequence_forecast")
def q_sequence_forecast(spark, sf_dir):
    """30-day windows → next day, ridge regression, predictions
    mapped back to sales units (T4) with per-day errors (M12)."""
    seqs, params = _sequences(spark, sf_dir)
    _, pred = sequence_regression(seqs.where("split = 'train'"), seqs.where("split = 'test'"))
    back = sc.inverse_scaler(pred.select("Date", F.col("target").alias("Sales"), "prediction")
                                 .withColumn("_p", F.col("prediction")), params, ["Sales"])
    back = sc.inverse_scaler(back.withColumnRenamed("Sales", "actual").withColumnRenamed("_p", "Sales"),
                             params, ["Sales"]).withColumnRenamed("Sales", "predicted")
    return mt.row_errors(back.select("Date", "actual", "predicted"), "actual", "predicted")


def _daily_features(spark, sf_dir):
    feats = agg.daily_features(cleaned_sales(spark, sf_dir), grain="day")
    num = ["daily", "daily_sells", "daily_total"]
    z = sc.scale(feats.withColumns({c: F.col(c).cast("double") for c in num}), num, "standard")
    return split_timestamp_ranges(z, "InvoiceDate", TRAIN_RANGE, TEST_RANGE)


_Q_FEATURES = ["daily_sells", "day_of_week", "daily_total"]
_T_FEATURES = ["daily_sells", "day_of_week", "daily"]


def _gbt(spark, sf_dir):
    """Hold-out and search (10 draws × 5 folds) on quantity, then both models with the best draw."""
    from tillpoint.forecast import boosting
    data = cut_lineage(_daily_features(spark, sf_dir), "checkpoint")
    tr = random_holdout(data.where("split = 'train'").drop("split"), ["InvoiceDate"])
    best = boosting.best_params(boosting.search(tr.where("split = 'train'"), _Q_FEATURES, "daily", "InvoiceDate"))
    rows = tr.unionByName(data.where("split = 'test'"))
    return boosting.fit_predict(rows, "split", "InvoiceDate", {"daily": (_Q_FEATURES, "daily"),
                                                               "daily_total": (_T_FEATURES, "daily_total")}, best)


@query("gbt_daily_metrics")
def q_gbt_daily_metrics(spark, sf_dir):
    """Features → split → the whole random search on quantity → revenue model
    with the same parameters → predictions (M7) → M9 for both targets on the test days."""
    test = _gbt(spark, sf_dir).where("split = 'test'").withColumnRenamed("name", "target")
    return mt.regression_metrics(test, "actual", "prediction", ["target"])


@query("gbt_validation_curve")
def q_gbt_validation_curve(spark, sf_dir):
    """M5: squared error on the 20 % hold-out after each tree, both models."""
    from tillpoint.forecast import boosting
    return boosting.validation_curve(_gbt(spark, sf_dir))


@query("gbt_predictions")
def q_gbt_predictions(spark, sf_dir):
    """M7: both predictions on the test days."""
    test = _gbt(spark, sf_dir).where("split = 'test'")
    return test.groupBy(F.col("key").alias("InvoiceDate")).agg(
        F.max(F.when(F.col("name") == "daily", F.col("prediction"))).alias("predicted_quantity"),
        F.max(F.when(F.col("name") == "daily_total", F.col("prediction"))).alias("predicted_total"))


@query("prophet_frame", with_sales(*CLEAN_CTES, _DAILY) + f"""
SELECT Date AS ds, Sales AS y, CASE WHEN Date <= DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split FROM d""")
def q_prophet_frame(spark, sf_dir):
    """F8: the additive model's input frame — ``Date``→``ds``, ``Sales``→``y``."""
    return daily_split(spark, sf_dir).withColumnsRenamed({"Date": "ds", "Sales": "y"})


@query("forest_regression_daily")
def q_forest_regression_daily(spark, sf_dir):
    """M14 (menu entry without a body in the original): random forest on the
    daily features; test metrics (M9)."""
    from tillpoint.forecast.models import fit_simple
    data = _daily_features(spark, sf_dir)
    feats = ["daily_sells", "day_of_week", "daily_total"]
    m = fit_simple(data.where("split = 'train'"), feats, "daily", "forest")
    return mt.regression_metrics(m.transform(data.where("split = 'test'")), "daily", "prediction")

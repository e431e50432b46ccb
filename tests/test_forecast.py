"""Forecast models recover planted series; splits and metrics behave."""

import datetime as dtm

import numpy as np
import pandas as pd

from tillpoint.forecast import metrics as mt
from tillpoint.forecast.additive import additive_forecast
from tillpoint.forecast.autoregressive import arima_forecast, difference, numbered
from tillpoint.forecast.split import random_holdout, split_at_date, split_timestamp_ranges
from tillpoint.operators.windows import add_position, sliding_sequences


def _series(spark, y, start="2020-01-01", split_at=None):
    dates = [dtm.date.fromisoformat(start) + dtm.timedelta(days=i) for i in range(len(y))]
    pdf = pd.DataFrame({"Date": dates, "Sales": y})
    pdf["split"] = np.where(np.arange(len(y)) < (split_at or int(len(y) * 0.8)), "train", "test")
    return spark.createDataFrame(pdf)


def test_additive_recovers_trend_and_week(spark):
    n = 400
    t = np.arange(n)
    y = 10 + 0.05 * t + 3 * np.sin(2 * np.pi * t / 7)
    out = additive_forecast(_series(spark, y, split_at=350)).toPandas()
    test = out[out.split == "test"]
    assert np.abs(test["Sales"] - test["yhat"]).max() < 0.5
    assert np.allclose(out["yhat"], out["trend"] + out["weekly"] + out["yearly"])


def test_arima_on_ar1_is_close(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(0, 0.1, 600)
    dy = np.zeros(600)
    for i in range(1, 600):
        dy[i] = 0.6 * dy[i - 1] + e[i]
    y = 50 + np.cumsum(dy)
    fc = arima_forecast(_series(spark, y, split_at=580), p=2, q=1).toPandas().sort_values("step")
    assert len(fc) == 20
    assert np.abs(fc["forecast"] - fc["actual"]).max() < 2.0


def test_split_overlap_and_hole(spark):
    s = _series(spark, np.arange(10.0))
    a = split_at_date(s.drop("split"), "Date", "2020-01-05").groupBy("split").count().toPandas()
    b = split_at_date(s.drop("split"), "Date", "2020-01-05", overlap=True).groupBy("split").count().toPandas()
    assert dict(zip(a.split, a["count"])) == {"train": 5, "test": 5}
    assert dict(zip(b.split, b["count"])) == {"train": 5, "test": 6}
    ts = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(
        ["2020-01-01 00:00", "2020-01-02 00:00", "2020-01-02 12:00", "2020-01-03 00:00"])}))
    closed = split_timestamp_ranges(ts, "ts", ("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-03"), closed=True)
    half = split_timestamp_ranges(ts, "ts", ("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-03"))
    assert closed.count() == 3 and half.count() == 4


def test_holdout_exact_size_and_partition_independent(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": range(101)}))
    a = random_holdout(df, ["k"]).where("split = 'val'").toPandas()["k"].sort_values().tolist()
    b = random_holdout(df.repartition(7), ["k"]).where("split = 'val'").toPandas()["k"].sort_values().tolist()
    assert len(a) == 21 and a == b


def test_metrics(spark):
    df = spark.createDataFrame(pd.DataFrame({"y": [1.0, 2.0, 0.0, 4.0], "p": [1.5, 2.0, 1.0, 3.0]}))
    m = mt.regression_metrics(df, "y", "p").first()
    assert np.isclose(m["mse"], (0.25 + 0 + 1 + 1) / 4) and np.isclose(m["rmse"], np.sqrt(2.25 / 4))
    assert np.isclose(m["r2"], 1 - 2.25 / (np.var([1, 2, 0, 4]) * 4))
    u = mt.rmse_mae_mape(df, "y", "p").first()
    assert u["mape_skipped"] == 1 and np.isclose(u["mape"], (50 + 0 + 25) / 3)
    g = mt.rmse_mae_mape_guarded(df, "y", "p").first()
    assert g["mape"] > 1e9


def test_sequences_with_halo(spark):
    s = _series(spark, np.arange(50.0)).drop("split")
    pos = add_position(s, "Date", [], "pos")
    seq = sliding_sequences(pos, "Sales", 5, "pos", block=7).toPandas().sort_values("Date")
    assert len(seq) == 45
    assert all(list(r.sequence) == [r.target - 5 + i for i in range(5)] for r in seq.itertuples())


def _weekly(seed, n=420, cut=392):
    """Season of 7, a slow walk and a regressor with coefficient 4."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = (rng.random(n) < 0.3).astype(float)
    y = 20 + np.array([0.0, 3, -2, 5, 1, -4, 2])[t % 7] + np.cumsum(rng.normal(0, 0.05, n)) + 4 * x
    start = dtm.date(2020, 1, 1)
    return pd.DataFrame({"Date": [start + dtm.timedelta(days=int(i)) for i in t], "Sales": y, "x": x,
                         "split": np.where(t < cut, "train", "test")})


def test_season_and_regressor_recovered_by_key(spark):
    parts = [_weekly(k).assign(k=k) for k in (1, 2)]
    both = spark.createDataFrame(pd.concat(parts))
    fc = arima_forecast(both, keys=["k"], p=2, q=1, season=7, exog=["x"]).toPandas().sort_values(["k", "step"])
    assert len(fc) == 56 and np.abs(fc["forecast"] - fc["actual"]).max() < 1.0
    plain = arima_forecast(both, keys=["k"], p=2, q=1).toPandas()
    assert np.abs(plain["forecast"] - plain["actual"]).mean() > 3 * np.abs(fc["forecast"] - fc["actual"]).mean()
    one = arima_forecast(spark.createDataFrame(parts[1]), p=2, q=1, season=7, exog=["x"]).toPandas().sort_values("step")
    assert np.allclose(one["forecast"], fc.loc[fc.k == 2, "forecast"], atol=1e-6)


def test_difference_and_numbering(spark):
    pdf = _weekly(3, 60, 50)
    rows = numbered(spark.createDataFrame(pdf).repartition(5), "Date", "split", [])
    got = difference(rows, "Sales", "pos", [], 7, block=13).toPandas().sort_values("Date")
    y = pdf["Sales"]
    want = y.diff() - y.shift(7).diff()
    assert got["pos"].tolist() == list(range(60)) and np.allclose(got["dy"], want, equal_nan=True)
    assert got["step"].isna().sum() == 50 and got["step"].dropna().tolist() == list(range(10))


def test_numbering_keeps_an_overlapping_day_apart(spark):
    pdf = _weekly(4, 20, 10)
    again = pdf.iloc[[9]].assign(split="test")
    got = numbered(spark.createDataFrame(pd.concat([pdf, again])), "Date", "split", []).toPandas()
    assert sorted(got.loc[got.split == "train", "pos"]) == list(range(10))
    assert got[got.split == "test"].sort_values("Date")["step"].tolist() == list(range(11))


def test_forecast_of_series_too_short_or_without_test(spark):
    short = _weekly(5, 6, 4).assign(k=1)
    whole = _weekly(6).assign(k=2)
    none = _weekly(7, 100, 100).assign(k=3)
    fc = arima_forecast(spark.createDataFrame(pd.concat([short, whole, none])), keys=["k"], p=2, q=1).toPandas()
    assert set(fc.k) == {2} and len(fc) == 28

"""Row index, quantiles, scalers, dates, cleaning on hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillpoint.functions import dates as dt
from tillpoint.operators import cleaning as cl
from tillpoint.operators import outliers as ol
from tillpoint.operators import profile as pf
from tillpoint.operators import scale as sc
from tillpoint.operators.encode import label_codes, one_hot
from tillpoint.operators.pca import fit_pca
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.operators.rowindex import process_batches, with_batches, with_row_index


@pytest.fixture
def dirty(spark):
    rows = [(1, 2.0, 10, "12/1/2010 8:26"), (-3, 1.5, None, "2010-12-02 09:00:00"),
            (None, 4.0, 12, "junk"), (5, float("nan"), 13, "12/3/2010 10:00"), (7, 0.5, 14, None)]
    return spark.createDataFrame(rows, "Quantity int, UnitPrice double, CustomerID long, InvoiceDate string")


def test_row_index_dense_and_partition_independent(spark):
    pdf = pd.DataFrame({"k": np.random.default_rng(0).permutation(1000), "v": np.arange(1000)})
    df = spark.createDataFrame(pdf)
    for parts in (1, 4, 16):
        got = with_row_index(df, ["k"], num_partitions=parts).toPandas()
        assert (got.sort_values("k")["row_idx"].to_numpy() == np.arange(1000)).all()
    b = with_batches(with_row_index(df, ["k"]), 300).groupBy("batch_number").count().toPandas()
    assert sorted(b["count"].tolist()) == [100, 300, 300, 300]


def test_process_batches_callback_skips_empty(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": range(10), "v": range(10)}))

    def cb(chunk, number):
        return None if number == 2 else chunk.assign(n=number)[["k", "n"]]

    out = process_batches(df, ["k"], 4, cb, "k long, n long").toPandas().sort_values("k")
    assert out["k"].tolist() == [0, 1, 2, 3, 8, 9] and out["n"].tolist() == [1, 1, 1, 1, 3, 3]


def test_exact_quantiles_match_numpy_with_hot_group_and_weights(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b"], 3000))
    v = np.round(rng.normal(size=3000), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "w": rng.integers(1, 4, 3000)}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = exact_quantiles(df, ["v"], probs, ["g"]).toPandas()
    for key in ("hot", "a", "b"):
        for p in probs:
            got = q[(q.g == key) & (np.isclose(q.prob, p))]["value"].iloc[0]
            assert math.isclose(got, np.quantile(v[g == key], p), abs_tol=1e-12)
    qw = exact_quantiles(df, ["v"], [0.5], weight_col="w").toPandas()["value"].iloc[0]
    assert math.isclose(qw, np.quantile(np.repeat(v, df.toPandas()["w"]), 0.5), abs_tol=1e-12)


@pytest.mark.parametrize("most", [1 << 20, 30, 4])
def test_brackets_cut_again_and_small_groups(spark, most):
    rng = np.random.default_rng(5)
    values = {"hot": np.round(rng.normal(0, 1, 3000), 3), "flat": np.zeros(400), "two": np.array([3.0, 1.0]), "one": np.array([7.0]),
              None: rng.exponential(1, 90), "ends": np.array([-1e300] + [0.5] * 50 + [1e300] * 2)}
    rows = [(g, float(x), float(-x)) for g, xs in values.items() for x in xs] + [("one", None, float("nan")), ("empty", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, u double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.6180339, 0.75, 0.99, 1.0]
    got = {(r.g, r.column, r.prob): r.value for r in exact_quantiles(df, ["v", "u"], probs, ["g"], most_values=most).collect()}
    assert len(got) == 2 * len(values) * len(probs)
    for g, xs in values.items():
        for p in probs:
            assert math.isclose(got[g, "v", p], np.quantile(xs, p), rel_tol=1e-12, abs_tol=1e-12), (g, p)
            assert math.isclose(got[g, "u", p], np.quantile(-xs, p), rel_tol=1e-12, abs_tol=1e-12), (g, p)


@pytest.mark.parametrize("fraction,n", [(0.2, 5000), (0.2, 7), (0.0, 9), (1.0, 9), (0.999, 1000), (0.37, 1)])
def test_holdout_by_threshold(spark, fraction, n):
    from tillpoint.forecast.split import random_holdout
    df = spark.range(n).withColumn("g", F.col("id") % 3)
    out = random_holdout(df.repartition(6), ["id", "g"], fraction)
    got = {r.id: r.split for r in out.collect()}
    hashes = sorted((r.h, r.id) for r in df.select("id", F.xxhash64(F.lit(42), "id", "g").alias("h")).collect())
    n_val = math.ceil(fraction * n)
    assert got == {i: "val" if k < n_val else "train" for k, (_, i) in enumerate(hashes)}
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()


def test_holdout_of_repeated_keys_and_no_rows(spark):
    from tillpoint.forecast.split import random_holdout
    df = spark.range(600).select((F.col("id") % 4).alias("k"))
    rows = random_holdout(df, ["k"], 0.3).groupBy("k", "split").count().collect()
    assert len(rows) == 4 and sum(r["count"] for r in rows if r.split == "val") >= 180
    assert random_holdout(df.limit(0), ["k"]).collect() == []


def test_quantiles_exchange_only_brackets(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003 / 7).alias("v"))
    out = exact_quantiles(df, ["v"], [0.25, 0.5, 0.75])
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    want = df.toPandas()["v"].quantile([0.25, 0.5, 0.75])
    assert {r.prob: r.value for r in out.collect()} == pytest.approx(want.to_dict(), rel=1e-12)
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).collect() == []


def test_scalers_edge_cases_and_inverse(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": [3.0, 3.0, 3.0], "x": [1.0, 2.0, 4.0]}))
    mm = sc.scale(df, ["c", "x"], "minmax").toPandas()
    assert mm["c"].tolist() == [0.0, 0.0, 0.0] and mm["x"].tolist() == [0.0, 1 / 3, 1.0]
    st = sc.scale(df, ["c"], "standard").toPandas()
    assert st["c"].tolist() == [0.0, 0.0, 0.0]
    rb = sc.scale(df, ["x"], "robust").toPandas()
    assert np.allclose(rb["x"], (np.array([1, 2, 4]) - 2.0) / 1.5)
    params = sc.fit_scaler(df, ["x"], "standard")
    back = sc.inverse_scaler(sc.apply_scaler(df, params, ["x"]), params, ["x"]).toPandas()
    assert np.allclose(back["x"], [1.0, 2.0, 4.0], atol=1e-9)


def test_dates_lenient_strict(spark, dirty):
    got = dirty.select(dt.parse_timestamp_lenient(F.col("InvoiceDate")).alias("t")).toPandas()["t"]
    assert got.isna().tolist() == [False, False, True, False, True]
    with pytest.raises(Exception):
        dirty.select(dt.parse_timestamp_strict(F.col("InvoiceDate"), "M/d/yyyy H:mm")).collect()


def test_filters_treat_nan_as_missing(spark, dirty):
    kept = cl.keep_non_negative(dirty).toPandas()
    assert kept["Quantity"].tolist() == [1, 7]
    assert cl.drop_missing(dirty, ["Quantity", "UnitPrice"]).count() == 3
    nulls = pf.null_counts(dirty).toPandas().set_index("column")["nulls"]
    assert nulls["UnitPrice"] == 1 and nulls["Quantity"] == 1 and nulls["CustomerID"] == 1


def test_outlier_modes(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [0.0] * 20 + [100.0], "b": [0.0] * 10 + [50.0] + [0.0] * 10}))
    assert ol.remove_by_threshold(df, ["a", "b"], 2.0, mode="first").count() == 20
    assert ol.remove_by_threshold(df, ["a", "b"], 2.0, mode="chained").count() == 19
    assert ol.remove_by_threshold(df, [], 2.0).count() == 21


def test_encoders(spark):
    df = spark.createDataFrame(pd.DataFrame({"s": ["b", "a", "c", "a"], "c": ["x", "y", "x", "z"]}))
    codes = label_codes(df, "s").toPandas().sort_values(["s"])
    assert codes["s_encoded"].tolist() == [0, 0, 1, 2]
    oh = one_hot(df, "c")
    assert [c for c in oh.columns if c.startswith("c_")] == ["c_y", "c_z"]


def test_pca_two_standardised_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2)); x[:, 1] += 0.5 * x[:, 0]
    df = sc.scale(spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"])), ["u", "v"])
    fit = fit_pca(df, ["u", "v"], 2)
    r = np.corrcoef(x.T)[0, 1]
    assert np.allclose(fit.explained_variance_ratio, [(1 + abs(r)) / 2, (1 - abs(r)) / 2])
    for c in fit.components:  # largest loading positive, first one on ties
        top = np.nonzero(np.abs(c) >= np.abs(c).max() - 1e-9)[0][0]
        assert c[top] > 0

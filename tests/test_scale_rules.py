"""Results that must not depend on plans, partitions or outliers; operators without caps."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tillpoint.cluster.components import connected_components
from tillpoint.cluster.knn import k_distance, k_distance_rows
from tillpoint.cluster.mixture import assign_mixture, inertia_k1
from tillpoint.forecast import boosting
from tillpoint.forecast.autoregressive import _shrinkage, arima_forecast
from tillpoint.forecast.linear import fit_least_squares
from tillpoint.forecast.models import fit_gbt, predict_both, tune_gbt
from tillpoint.operators.encode import kmeans_design, one_hot_vector
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.operators.rowindex import with_row_index
from tillpoint.operators.windows import add_position
from tillpoint.plans.cleaning import cleaned_lines
from tillpoint.plans.forecasting import daily_split
from tillpoint.session import ensure_checkpoint_dir
from tillpoint.sources.sales import ORDER_KEYS, SHORT_KEYS, read_sales_csv, sales_from_tables, sales_lines


@pytest.mark.parametrize("partitions, adaptive, reuse", [
    (1, "true", "true"), (1, "false", "false"), (3, "true", "false"), (3, "false", "true"),
    (8, "true", "false"), (8, "false", "false"), (50, "true", "true"), (50, "false", "false")])
def test_quantiles_do_not_depend_on_the_plan(spark, reuse, adaptive, partitions):
    confs = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": str(partitions)}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 4099 / 7.0).alias("v"))
        got = {(r.g, r.prob): r.value for r in exact_quantiles(df, ["v"], [0.25, 0.5, 0.9], ["g"]).collect()}
        want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("p")).collect()
        assert got == pytest.approx({(r.g, p): v for r in want for p, v in zip((0.25, 0.5, 0.9), r.p)})
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_hot_of_many_categories(spark):
    n = 5000
    df = spark.range(n).select(F.format_string("c%05d", "id").alias("c"), F.lit(1.0).alias("x"))
    df = df.unionByName(spark.createDataFrame([(None, 2.0)], "c string, x double"))
    rows = {r.c: r.c_vector for r in one_hot_vector(df, "c").where("c is null or c in ('c00000', 'c00001', 'c04999')").collect()}
    assert rows["c00000"].numNonzeros() == 0 and rows[None].numNonzeros() == 0
    assert rows["c00001"].numNonzeros() == rows["c04999"].numNonzeros() == 1
    assert {len(v) for v in rows.values()} == {n - 1}


def test_design_vector_inertia(spark):
    pdf = pd.DataFrame({"Country": ["a", "b", "b", "c"], "StockCode": ["x", "y", "x", "z"], "Quantity": [1.0, 2, 3, 5], "UnitPrice": [1.0, 1, 4, 2]})
    design, feats = kmeans_design(spark.createDataFrame(pdf))
    dummies = pd.get_dummies(pdf["Country"], drop_first=True).to_numpy(float)
    m = np.column_stack([pdf["Quantity"], pdf["UnitPrice"], dummies, pdf["StockCode"].astype("category").cat.codes])
    assert inertia_k1(design, feats).first()["inertia"] == pytest.approx(((m - m.mean(axis=0)) ** 2).sum())


def test_csv_ids_and_malformed_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
        '1,A,"two\nlines",6,12/1/2010 8:26,2.55,17850.0,France\n2,B,x,1.5,12/1/2010 8:26,oops,17850,France\n'
        "3,C,y,-2,,,,France\n4,D,z,7,12/1/2010 8:26,1.0,12 34,France\n")
    rows = {r.InvoiceNo: r for r in read_sales_csv(spark, str(tmp_path), multi_line=True, malformed="bad").collect()}
    assert rows["1"].CustomerID == rows["2"].CustomerID == 17850 and rows["1"].Description == "two\nlines"
    assert rows["1"].bad == [] and rows["3"].bad == [] and rows["3"].CustomerID is None
    assert rows["2"].bad == ["Quantity", "UnitPrice"] and rows["2"].Quantity is None and rows["4"].bad == ["CustomerID"]


def test_positions_use_no_single_partition(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.lit(5000) - F.col("id")).alias("t"))
    for keys in ([], ["k"]):
        out = add_position(df, "t", keys, "pos")
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
        got = out.toPandas().sort_values([*keys, "t"])
        want = got.groupby(keys).cumcount() if keys else pd.Series(range(len(got)))
        assert got["pos"].tolist() == want.tolist()


def test_row_index_reads_offsets_by_position(spark):
    out = with_row_index(spark.range(2000).withColumn("r", F.hash("id")), ["r"], num_partitions=37)
    assert "map(" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert sorted(r.row_idx for r in out.select("row_idx").collect()) == list(range(2000))


def test_sales_scan_reads_only_its_columns(spark):
    plan = sales_from_tables(spark, SMALL, with_keys=False).where("Quantity > 3")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan


def test_empty_fit_has_no_coefficients(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "k int, x double, y double")
    got = fit_least_squares(df, ["x"], "y", ["k"], ridge=0.0).collect()
    assert [(r.k, r.n) for r in got] == [(2, 2)] and got[0].coef == pytest.approx([0.0, 2.0], abs=1e-9)
    assert fit_least_squares(df.where("false"), ["x"], "y").collect() == []


def test_keyed_forecast_equals_the_series_alone(spark):
    days = pd.date_range("2020-01-01", periods=200)
    rows = pd.concat([pd.DataFrame({"k": k, "Date": days.date, "Sales": 10 * k + np.sin(np.arange(200) / (2 + k)),
                                    "split": np.where(np.arange(200) < 180, "train", "test")}) for k in (1, 2)])
    df = spark.createDataFrame(rows)
    both = arima_forecast(df, keys=["k"], p=3, q=2).toPandas()
    for k in (1, 2):
        one = arima_forecast(df.where(f"k = {k}").drop("k"), p=3, q=2).toPandas().sort_values("step")
        assert np.allclose(both[both.k == k].sort_values("step")["forecast"], one["forecast"])
        assert len(one) == 20 and (one["shrinkage"] <= 1).all()


def test_shrinkage_is_exact():
    for phi in (np.array([1.5]), np.array([0.2, 1.1]), np.array([2.0, -0.3, 0.8])):
        s = _shrinkage(phi)
        small = phi * s ** np.arange(1, len(phi) + 1)
        assert 0 < s < 1 and _shrinkage(small) == 1.0
    assert _shrinkage(np.array([0.5])) == 1.0 and _shrinkage(np.zeros(0)) == 1.0


def test_k_distance_with_a_far_outlier_and_a_constant_column(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (400, 2)), rng.normal(5, 0.1, (400, 2)), [[1e3, -1e3]]])
    for pts in (x, np.column_stack([x[:, 0], np.full(len(x), 3.0)])):
        df = spark.createDataFrame(pd.DataFrame({"row_idx": range(len(pts)), "a": pts[:, 0], "b": pts[:, 1]}))
        got = k_distance_rows(df, ["a", "b"], 5).toPandas().sort_values("row_idx")["kdist"].to_numpy()
        d = np.sort(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2)), axis=1)[:, 4]
        assert np.allclose(got, d)
    same = spark.createDataFrame(pd.DataFrame({"row_idx": range(9), "a": 1.0, "b": 2.0}))
    assert k_distance(same, ["a", "b"], 5).first()["kdist"] == 0.0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_mixture_assignment_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    w, m, c = [0.7, 0.3], [[0, 0], [1, 1]], [[[1, .2], [.2, 1]], [[.5, 0], [0, .7]]]
    dens = np.array([w[k] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k]))
                     / (2 * np.pi * np.sqrt(np.linalg.det(c[k]))) for k in range(2)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "a": x[:, 0], "b": x[:, 1]}))
    got = assign_mixture(df, ["a", "b"], w, m, c).toPandas().sort_values("i")
    assert (got["cluster"].to_numpy() == dens.argmax(axis=0)).all()
    assert np.allclose(got["probability"], dens.max(axis=0) / dens.sum(axis=0))


def test_boosting_fits_and_searches(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + x[:, 1]
    params = {"maxIter": 60, "stepSize": 0.2, "maxDepth": 3, "subsamplingRate": 0.8, "colsample": 1.0}
    (guess,), curve = boosting.boost(x[:300], y[:300], [x[300:]], params, 1)
    assert ((guess - y[300:]) ** 2).mean() < 0.02 and ((curve[0] - y[300:]) ** 2).mean() > 0.3
    assert np.allclose(curve[-1], guess)
    df = spark.createDataFrame(pd.DataFrame({"k": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y,
                                             "split": np.where(np.arange(400) < 300, "train", "val")}))
    table = boosting.search(df.where("split = 'train'"), ["a", "b", "c"], "y", "k", n_draws=3, n_folds=2)
    assert table.count() == 3 and table.where("cv_mse is null").count() == 0
    best = boosting.best_params(table)
    pred = boosting.fit_predict(df, "split", "k", {"m": (["a", "b", "c"], "y")}, best)
    assert pred.count() == 100
    losses = boosting.validation_curve(pred).toPandas().sort_values("tree")["mse"].to_numpy()
    assert len(losses) == best["maxIter"] and losses[-1] < losses[0]


def test_mllib_search_and_both_predictions(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.random(60), "b": rng.random(60)}).assign(y=lambda d: d.a * 3, z=lambda d: d.b + d.a)
    df = spark.createDataFrame(pdf)
    import tillpoint.forecast.models as M
    old, M.TREES = M.TREES, (2, 4)
    try:
        model, params, table = tune_gbt(df, ["a", "b"], "y", n_draws=2, n_folds=2)
    finally:
        M.TREES = old
    assert table.count() == 2 and params["maxIter"] in (2, 3)
    other, curve = fit_gbt(df, ["a", "b"], "z", params, df)
    assert curve.count() == params["maxIter"]
    out = predict_both(model, other, df, ["a", "b"], ["a", "b"])
    assert {"predicted_quantity", "predicted_total"} <= set(out.columns) and out.count() == 60


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_the_registered_k_distance_curve_has_every_row(spark):
    import __spark_entry__ as E
    from conftest import SMALL
    kd = E.queries()["k_distance"](spark, SMALL).toPandas()
    curve = E.queries()["k_distance_curve"](spark, SMALL).toPandas().sort_values("rank")
    assert curve["rank"].tolist() == list(range(int(kd.w.sum())))
    assert np.allclose(curve.distance, np.sort(np.repeat(kd.kdist, kd.w.astype(int))))
    assert len(E.queries()["k_distance_curve_101"](spark, SMALL).collect()) == 101


def _sales_tables(spark, path):
    """Small tables with repeated orders and lines, missing keys and values."""
    day = lambda n: f"2000-01-{n:02d} 00:00:00"
    lines = [(o, p, 1, n, q, 10.0 * n, f, day(n)) for o, p, n, q, f in [
        (7, 1, 1, 5.0, "R"), (7, 2, 2, 3.0, "N"), (7, 2, 2, 3.0, "N"), (3, 1, 1, 4.0, "N"), (3, 9, 2, 1.0, "N"),
        (5, 2, 3, None, "N"), (None, 1, 1, 2.0, "N"), (8, 1, 1, 2.0, None)]]
    frames = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                            "l_extendedprice double, l_returnflag string, l_shipdate string"),
        "orders": ([(7, 11, day(2)), (3, 12, day(1)), (3, 11, day(1)), (5, 13, day(3)), (8, None, day(4)), (None, 11, day(5))],
                   "o_orderkey long, o_custkey long, o_orderdate string"),
        "part": ([(1, "ring", 2.5), (2, None, 1.5), (None, "x", 1.0)], "p_partkey long, p_name string, p_retailprice double"),
        "customer": ([(11, 1), (12, 1), (13, 2), (None, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(1, "A"), (2, None)], "n_nationkey int, n_name string")}
    for name, (rows, schema) in frames.items():
        df = spark.createDataFrame(rows, schema)
        for c in ("l_shipdate", "o_orderdate"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_narrow_sales_lines_are_the_rows_of_the_sales_view(spark, tmp_path):
    d = _sales_tables(spark, tmp_path)
    key = lambda rows: sorted(map(str, rows))
    wide = sales_from_tables(spark, d)
    assert sales_lines(spark, d).schema.simpleString() == wide.schema.simpleString() and wide.count() == 6
    assert key(sales_lines(spark, d).collect()) == key(wide.collect())
    short = sales_lines(spark, d, [*SHORT_KEYS, "l_partkey"]).orderBy(*SHORT_KEYS).collect()
    assert [r.l_partkey for r in short] == [r.l_partkey for r in wide.orderBy(*ORDER_KEYS).collect()]


def test_sales_lines_are_exchanged_twice_and_numbered_on_the_way(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sales_lines(spark, SMALL, [*SHORT_KEYS, "Quantity", "UnitPrice", "CustomerID"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    by = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^,]*)", plan)]
    assert sorted(x for x in by if x.startswith("l_")) == ["l_orderkey", "l_partkey"]


def test_dbscan_rows_are_exchanged_without_their_scaled_values(spark, monkeypatch):
    from tillpoint.cluster import batched, dbscan

    seen = []
    cut = dbscan.cut_lineage
    monkeypatch.setattr(dbscan, "cut_lineage", lambda df, how="checkpoint": (
        seen.append((df, df._jdf.queryExecution().optimizedPlan().toString())), cut(df, how))[1])
    rows = spark.range(400).select((F.col("id") % 7).cast("int").alias("Quantity"), (F.col("id") % 11 * 0.5).alias("UnitPrice"),
                                   (F.col("id") % 13).alias("CustomerID"), "id")
    out = batched.dbscan_type2(rows, ["id"], batch_size=100)
    assert out.columns == ["batch_number", "Quantity", "UnitPrice", "CustomerID", "id", "row_idx", "Cluster", "BatchNumber"]
    rows, plan = seen[0]
    above, below = plan.split("RepartitionByExpression", 1)
    assert " AS _x0" in above and " AS _x0" not in below and "Quantity_s#" not in below
    # grouping by cells needs no further exchange
    cells = rows.groupBy("batch_number", "_c0", "_c1", "_c2").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in cells.split("InMemoryTableScan")[0]


def test_daily_split_reads_the_lines_once_and_caches_only_what_it_sums(spark):
    spark.catalog.clearCache()
    plan = daily_split(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Aggregate" not in plan
    lines = cleaned_lines(spark, SMALL, ["InvoiceDate", "Quantity", "UnitPrice"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Description" not in re.search(r"InMemoryRelation \[([^\]]*)\]", lines)[1]


def test_arima_stages_do_not_carry_earlier_plans(spark):
    days = pd.date_range("2020-01-01", periods=120)
    df = spark.createDataFrame(pd.DataFrame({"Date": days.date, "Sales": np.sin(np.arange(120) / 3),
                                             "split": np.where(np.arange(120) < 100, "train", "test")}))
    plan = arima_forecast(df, p=2, q=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "InMemoryRelation" not in plan


def test_cluster_summary_counts_customers_of_missing_batches(spark):
    from tillpoint.operators.aggregates import cluster_summary

    df = spark.createDataFrame([(1, 0, 2, 1.0, 5), (1, 0, 3, 2.0, 5), (1, 0, 4, 3.0, None), (None, 0, 1, 1.0, 6), (None, 0, 1, 1.0, 7),
                                (2, 1, 1, 1.0, None), (2, -1, 1, 1.0, 9)], "b int, Cluster int, Quantity int, UnitPrice double, CustomerID long")
    got = {(r.b, r.Cluster): (r.Quantity_count, r.Quantity_mean, r.CustomerID_nunique) for r in cluster_summary(df, keys=["b"]).collect()}
    assert got == {(1, 0): (3, 3.0, 1), (None, 0): (2, 1.0, 2), (2, 1): (1, 1.0, 0)}


def test_split_sizes_reads_the_cached_lines_for_the_ranges_alone(spark):
    from tillpoint.plans.transforms import q_split_sizes

    out = q_split_sizes(spark, SMALL)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") <= 2
    assert out.count() == 8

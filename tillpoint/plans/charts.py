"""Registered queries: chart tables (C1–C9), the streaming batch form (S3),
sinks (S4, S5) and model persistence (S6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillpoint.forecast.autoregressive import arima_forecast
from tillpoint.forecast.models import load_model, save_model
from tillpoint.operators import aggregates as agg
from tillpoint.operators import charts as ch
from tillpoint.operators import scale as sc
from tillpoint.operators.cleaning import ZOOM_PCA, ZOOM_SCALED, drop_missing
from tillpoint.operators.encode import label_codes
from tillpoint.operators.encoded_pca import fit_encoded_pca
from tillpoint.operators.pca import fit_pca
from tillpoint.plans import clustering as qc
from tillpoint.plans.common import CLEAN_CTES, r, rounded, with_sales
from tillpoint.plans.forecasting import _NAIVE, naive_pairs, scaled_split
from tillpoint.plans.registry import query
from tillpoint.plans.transforms import TEST_RANGE
from tillpoint.session import cut_lineage, scratch_path
from tillpoint.sources.sales import read_sales_csv, sales_from_tables, write_csv
from tillpoint.streaming.batches import run_file_batches

Q_BIN, P_BIN, Z_BIN = 5.0, 10.0, 0.5


@query("scatter_bins_assigned", with_sales(*CLEAN_CTES, *qc._ASSIGN_CTES) + f"""
SELECT CAST(floor(Quantity / {Q_BIN}) AS BIGINT) AS x_bin, CAST(floor(UnitPrice / {P_BIN}) AS BIGINT) AS y_bin,
  Cluster, count(*) AS count FROM asg GROUP BY 1, 2, 3""")
def q_scatter_bins_assigned(spark, sf_dir):
    """Quantity × UnitPrice scatter as 2-D bin counts per cluster."""
    return ch.scatter_bins(qc.quantile_seeded(spark, sf_dir), "Quantity", "UnitPrice", Q_BIN, P_BIN)


@query("scatter_bins_zoom", with_sales(*CLEAN_CTES, *qc._ASSIGN_CTES,
    "st AS (SELECT avg(Quantity) AS mq, stddev_pop(Quantity) AS sq, avg(UnitPrice) AS mp, stddev_pop(UnitPrice) AS sp FROM asg)",
    "z AS (SELECT (Quantity - mq) / sq AS zq, (UnitPrice - mp) / sp AS zp, Cluster FROM asg, st)") + f"""
SELECT CAST(floor(zq / {Z_BIN}) AS BIGINT) AS x_bin, CAST(floor(zp / {Z_BIN}) AS BIGINT) AS y_bin, Cluster,
  count(*) AS count FROM z
WHERE zq BETWEEN {ZOOM_SCALED[0][0]} AND {ZOOM_SCALED[0][1]} AND zp BETWEEN {ZOOM_SCALED[1][0]} AND {ZOOM_SCALED[1][1]}
GROUP BY 1, 2, 3""")
def q_scatter_bins_zoom(spark, sf_dir):
    """C3 + F13: the zoomed chart of standardised values (x −0.5…3.5, y 0…35)."""
    z = sc.scale(qc.quantile_seeded(spark, sf_dir), ["Quantity", "UnitPrice"], "standard")
    return ch.scatter_bins(z, "Quantity", "UnitPrice", Z_BIN, Z_BIN, "Cluster",
                           ZOOM_SCALED[0], ZOOM_SCALED[1])


def _pca_scatter(spark, sf_dir, labelled, zoom: bool):
    z = sc.scale(labelled, ["Quantity", "UnitPrice"], "standard")
    scores = rounded(fit_pca(z, ["Quantity", "UnitPrice"], 2).transform(z), 4)
    window = ZOOM_PCA if zoom else (None, None)
    return ch.scatter_bins(scores, "pc1", "pc2", Z_BIN, Z_BIN, "Cluster", *window)


def _pca_scatter_sql(src: str, zoom: bool) -> tuple[list[str], str]:
    inside = (f"WHERE pc1 BETWEEN {ZOOM_PCA[0][0]} AND {ZOOM_PCA[0][1]} AND pc2 BETWEEN {ZOOM_PCA[1][0]} AND {ZOOM_PCA[1][1]}"
              if zoom else "")
    ctes = [f"pst AS (SELECT avg(Quantity) AS amq, stddev_pop(Quantity) AS asq, avg(UnitPrice) AS amp, stddev_pop(UnitPrice) AS asp FROM {src})",
            f"pz AS (SELECT (Quantity - amq) / asq AS z1, (UnitPrice - amp) / asp AS z2, Cluster FROM {src}, pst)",
            "pc AS (SELECT sign(corr(z1, z2)) AS s FROM pz)",
            f"ps AS (SELECT {r('(z1 + s * z2) / sqrt(2)', 4)} AS pc1, {r('(z1 - s * z2) / sqrt(2)', 4)} AS pc2, Cluster FROM pz, pc)"]
    return ctes, f"""SELECT CAST(floor(pc1 / {Z_BIN}) AS BIGINT) AS x_bin, CAST(floor(pc2 / {Z_BIN}) AS BIGINT) AS y_bin,
  Cluster AS Cluster, count(*) AS count FROM ps {inside} GROUP BY 1, 2, 3"""


def _register_pca_scatters() -> None:
    kinds = {"assigned": (qc._ASSIGN_CTES, "asg", qc.quantile_seeded, "K-Means assignment"),
             "mixture": (qc._MIXTURE_CTES, "mix", lambda s, d: qc._fixed_mixture(s, d).withColumnRenamed("cluster", "Cluster"),
                         "mixture assignment")}
    for kind, (ctes, src, labelled, what) in kinds.items():
        for zoom in (False, True):
            extra, body = _pca_scatter_sql(src, zoom)

            def run(spark, sf_dir, labelled=labelled, zoom=zoom):
                return _pca_scatter(spark, sf_dir, labelled(spark, sf_dir), zoom)

            run.__doc__ = f"C3 in PCA space for the {what}" + (", F13: zoomed (x −5…5, y 0…20)." if zoom else ".")
            query(f"pca_scatter_{kind}" + "_zoom" * zoom, with_sales(*CLEAN_CTES, *ctes, *extra) + body)(run)


_register_pca_scatters()


_DESIGN_NUMERIC = ["Quantity", "UnitPrice", "StockCode_encoded", "Cluster"]
DESIGN_BINS = (25.0, 5.0)       # the first component follows the stock codes, the second the unit price


def _design_pca(spark, sf_dir):
    """The K-Means design with its labels, as the original scatters it, and its two leading components."""
    lines = label_codes(drop_missing(qc.quantile_seeded(spark, sf_dir)), "StockCode", "StockCode_encoded")
    design = cut_lineage(lines.select(*_DESIGN_NUMERIC, "Country"))
    return design, fit_encoded_pca(design, _DESIGN_NUMERIC, ["Country"], 2)


def _power_ctes(name: str, source: str, squarings: int = 9) -> list[str]:
    """Leading eigenvector (``name``: i, w) and value (``name_l``) of the matrix in ``source`` (i, j, v): a high
    power by repeated squaring, its column with the greatest diagonal entry, the greatest loading positive."""
    out, prev = [], source
    for t in range(squarings):
        out.append(f"{name}_r{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {prev} a JOIN {prev} b ON a.j = b.i GROUP BY 1, 2)")
        out.append(f"{name}_m{t} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}_r{t} WHERE i = j) AS v FROM {name}_r{t})")
        prev = f"{name}_m{t}"
    return out + [
        f"{name}_c AS (SELECT i, v FROM {prev} WHERE j = (SELECT arg_max(i, v) FROM {prev} WHERE i = j))",
        f"{name} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM {name}_c) AS w FROM {name}_c)",
        f"{name}_l AS (SELECT sum(a.w * s.v * b.w) AS l FROM {source} s JOIN {name} a ON s.i = a.i JOIN {name} b ON s.j = b.i)"]


_DESIGN_CTES = [
    *qc._ASSIGN_CTES,
    "cd AS MATERIALIZED (SELECT row_number() OVER () AS rid, Quantity, UnitPrice, Cluster, Country, "
    "dense_rank() OVER (ORDER BY StockCode) - 1 AS code FROM asg WHERE CustomerID IS NOT NULL)",
    "mu AS (SELECT avg(Quantity) AS q, avg(UnitPrice) AS p, avg(code) AS c, avg(Cluster) AS k, count(*) AS n FROM cd)",
    "ft AS (SELECT Country, 3 + row_number() OVER (ORDER BY Country) AS i FROM (SELECT DISTINCT Country FROM cd "
    "WHERE Country <> (SELECT min(Country) FROM cd)))",
    "x AS MATERIALIZED (SELECT rid, 0 AS i, Quantity - q AS v FROM cd, mu UNION ALL SELECT rid, 1, UnitPrice - p FROM cd, mu "
    "UNION ALL SELECT rid, 2, code - c FROM cd, mu UNION ALL SELECT rid, 3, Cluster - k FROM cd, mu "
    "UNION ALL SELECT rid, ft.i, 1.0 FROM cd JOIN ft USING (Country))",
    "m AS (SELECT i, sum(v) / (SELECT n FROM mu) AS m FROM x GROUP BY 1)",
    "g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (rid) GROUP BY 1, 2)",
    "cov AS MATERIALIZED (SELECT a.i, b.i AS j, (coalesce(g.v, 0) - n * a.m * b.m) / (n - 1) AS v "
    "FROM mu, m a CROSS JOIN m b LEFT JOIN g ON g.i = a.i AND g.j = b.i)",
    *_power_ctes("e1", "cov"),
    "cov2 AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - l * a.w * b.w AS v FROM e1_l, cov JOIN e1 a ON cov.i = a.i JOIN e1 b ON cov.j = b.i)",
    *_power_ctes("e2", "cov2"),
    "sc AS (SELECT x.rid, sum(x.v * e1.w) - (SELECT sum(m.m * e1.w) FROM m JOIN e1 USING (i)) AS pc1, "
    "sum(x.v * e2.w) - (SELECT sum(m.m * e2.w) FROM m JOIN e2 USING (i)) AS pc2 "
    "FROM x JOIN e1 ON x.i = e1.i JOIN e2 ON x.i = e2.i GROUP BY 1)",
]


@query("pca_scatter_kmeans_design", with_sales(*CLEAN_CTES, *_DESIGN_CTES) + f"""
SELECT CAST(floor({r('pc1', 4)} / {DESIGN_BINS[0]}) AS BIGINT) AS x_bin, CAST(floor({r('pc2', 4)} / {DESIGN_BINS[1]}) AS BIGINT) AS y_bin,
  Cluster, count(*) AS count FROM sc JOIN cd USING (rid) GROUP BY 1, 2, 3""")
def q_pca_scatter_kmeans_design(spark, sf_dir):
    """C3 + T7: the K-Means scatter in the plane of the encoded matrix's two components (numbers, stock codes,
    country dummies and, as the original has it, the labels)."""
    design, fit = _design_pca(spark, sf_dir)
    return ch.scatter_bins(rounded(fit.transform(design), 4), "pc1", "pc2", *DESIGN_BINS, "Cluster")


@query("pca_design_variance", with_sales(*CLEAN_CTES, *_DESIGN_CTES) + f"""
SELECT 1 AS component, {r('l', 4)} AS variance, {r('l / (SELECT sum(v) FROM cov WHERE i = j)')} AS ratio FROM e1_l
UNION ALL SELECT 2, {r('l', 4)}, {r('l / (SELECT sum(v) FROM cov WHERE i = j)')} FROM e2_l""")
def q_pca_design_variance(spark, sf_dir):
    """T8 on the encoded matrix."""
    out = _design_pca(spark, sf_dir)[1].variance_frame(spark)
    return out.select("component", F.round("variance", 4).alias("variance"), F.round("ratio", 6).alias("ratio"))


@query("pca_design_loadings", with_sales(*CLEAN_CTES, *_DESIGN_CTES,
    "nm(i, feature) AS (VALUES (0, 'Quantity'), (1, 'UnitPrice'), (2, 'StockCode_encoded'), (3, 'Cluster'))",
    "na AS (SELECT * FROM nm UNION ALL SELECT i, 'Country_' || Country FROM ft)")
    + f"SELECT feature, {r('e1.w', 5)} + 0.0 AS pc1, {r('e2.w', 5)} + 0.0 AS pc2 FROM na JOIN e1 USING (i) JOIN e2 USING (i)")
def q_pca_design_loadings(spark, sf_dir):
    """T7 on the encoded matrix: the loading of every encoded column."""
    out = rounded(_design_pca(spark, sf_dir)[1].loadings_frame(spark), 5)
    return out.select("feature", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("pc1", "pc2")])  # no negative zero


@query("residuals_naive", _NAIVE + f"""
SELECT forecast AS predicted, {r('actual - forecast', 2)} AS residual FROM pr""")
def q_residuals_naive(spark, sf_dir):
    """Residual against prediction (seasonal-naive forecast)."""
    t = ch.residual_table(naive_pairs(spark, sf_dir), "actual", "forecast")
    return t.select("predicted", F.round("residual", 2).alias("residual"))


@query("train_test_predicted")
def q_train_test_predicted(spark, sf_dir):
    """Train, test and predicted series in long form (ARIMA forecast)."""
    s = scaled_split(spark, sf_dir)
    fc = arima_forecast(s, "Date", "Sales", "split", p=12, q=12)
    return ch.series_long({"train": s.where("split = 'train'"), "test": s.where("split = 'test'")},
                          "Date", "Sales").unionByName(
        ch.series_long({"predicted": fc}, "Date", "forecast"))


@query("streaming_daily_sales", with_sales() + """
SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales
FROM sales GROUP BY 1""")
def q_streaming_daily_sales(spark, sf_dir):
    """S3 streaming form: the invoice lines land as files, a file per
    micro-batch is turned into daily partial sums (A1 per batch), partial
    sums are combined at the end."""
    base = scratch_path(spark, f"stream_{uuid.uuid4().hex}")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    sales = sales_from_tables(spark, sf_dir, with_keys=False)
    sales.write.parquet(src)

    def per_batch(batch, number):
        return batch.groupBy(F.to_date("InvoiceDate").alias("Date")).agg(
            F.sum(F.col("Quantity") * F.col("UnitPrice")).alias("part"))

    run_file_batches(spark, src, sales.schema, per_batch, sink, ckpt)
    return (spark.read.parquet(sink).groupBy("Date")
            .agg(F.bround(F.sum("part"), 2).alias("Sales")))


@query("summary_csv_roundtrip", with_sales(*CLEAN_CTES, *qc._ASSIGN_CTES) + f"""
SELECT Cluster, {r('avg(Quantity)')} AS Quantity_mean, min(Quantity) AS Quantity_min, max(Quantity) AS Quantity_max,
  count(Quantity) AS Quantity_count, {r('avg(UnitPrice)')} AS UnitPrice_mean, {r('min(UnitPrice)')} AS UnitPrice_min,
  {r('max(UnitPrice)')} AS UnitPrice_max, count(DISTINCT CustomerID) AS CustomerID_nunique
FROM asg WHERE Cluster <> -1 GROUP BY 1""")
def q_summary_csv_roundtrip(spark, sf_dir):
    """S5 + S4: the two-level cluster summary written flat (``Quantity_mean`` …)
    as headered CSV and read back with its schema."""
    summary = rounded(agg.cluster_summary(qc.quantile_seeded(spark, sf_dir), "Cluster"))
    path = scratch_path(spark, f"summary_{uuid.uuid4().hex}")
    write_csv(summary, path)
    return spark.read.schema(summary.schema).option("header", True).csv(path)


@query("model_roundtrip_diff", with_sales(*CLEAN_CTES) + f"""
SELECT count(DISTINCT CAST(InvoiceDate AS DATE)) AS days, 0.0::DOUBLE AS largest_diff FROM clean
WHERE InvoiceDate >= TIMESTAMP '{TEST_RANGE[0]}' AND InvoiceDate < TIMESTAMP '{TEST_RANGE[1]}' + INTERVAL 1 DAY""")
def q_model_roundtrip_diff(spark, sf_dir):
    """S6, exact part: the reloaded model predicts every test day as the original does."""
    return q_model_roundtrip(spark, sf_dir).agg(F.count("InvoiceDate").alias("days"), F.max("diff").alias("largest_diff"))


@query("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """A fitted pipeline (forest on the daily features) saved, loaded and
    used again; returns the reloaded model's test predictions and how far they
    are from the original model's (0 expected)."""
    from tillpoint.forecast.models import fit_simple
    from tillpoint.plans.forecasting import _daily_features
    data = _daily_features(spark, sf_dir)
    feats = ["daily_sells", "day_of_week", "daily_total"]
    model = fit_simple(data.where("split = 'train'"), feats, "daily", "forest")
    path = scratch_path(spark, f"model_{uuid.uuid4().hex}")
    save_model(model, path)
    again = load_model(path)
    test = data.where("split = 'test'")
    a = model.transform(test).select("InvoiceDate", F.col("prediction").alias("p1"))
    b = again.transform(test).select("InvoiceDate", F.col("prediction").alias("p2"))
    return a.join(b, "InvoiceDate").withColumn("diff", F.abs(F.col("p1") - F.col("p2")))


@query("linear_regression_daily")
def q_linear_regression_daily(spark, sf_dir):
    """M15 (menu entry without a body in the original): linear regression on
    the daily features; test metrics (M9)."""
    from tillpoint.forecast import metrics as mt
    from tillpoint.forecast.models import fit_simple
    from tillpoint.plans.forecasting import _daily_features
    data = _daily_features(spark, sf_dir)
    feats = ["daily_sells", "day_of_week", "daily_total"]
    m = fit_simple(data.where("split = 'train'"), feats, "daily", "linear")
    return mt.regression_metrics(m.transform(data.where("split = 'test'")), "daily", "prediction")

"""Registered queries: scalers, encoders, PCA, splits (§2.9, F9–F11, P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.forecast.split import split_at_date, split_date_ranges, split_timestamp_ranges
from tillpoint.operators import aggregates as agg
from tillpoint.operators import cleaning as cl
from tillpoint.operators import encode as enc
from tillpoint.operators import scale as sc
from tillpoint.operators.pca import fit_pca
from tillpoint.operators.rowindex import with_batches, with_row_index
from tillpoint.plans.cleaning import cleaned_lines, cleaned_sales, daily_cleaned
from tillpoint.plans.common import CLEAN_CTES, KEYS_SQL, r, rounded, with_sales
from tillpoint.plans.registry import query
from tillpoint.plans.series import BATCH_SIZE
from tillpoint.session import cut_lineage
from tillpoint.sources.sales import ORDER_KEYS, sales_from_tables

# Split dates moved into the test data's years (FIXTURES.md §B "Dates").
SPLIT_DATE = "2001-06-30"
TRAIN_RANGE = ("1995-01-01", "2001-06-30")  # from the first day: train and test are the whole series
TEST_RANGE = ("2001-07-01", "2001-08-01")

_DAILY = "d AS (SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales FROM clean GROUP BY 1)"


@query("standardize_clean", with_sales(*CLEAN_CTES,
    "st AS (SELECT avg(Quantity) AS mq, stddev_pop(Quantity) AS sq, avg(UnitPrice) AS mp, stddev_pop(UnitPrice) AS sp FROM clean)")
    + f"SELECT {KEYS_SQL}, {r('(Quantity - mq) / sq')} AS Quantity, {r('(UnitPrice - mp) / sp')} AS UnitPrice FROM clean, st")
def q_standardize_clean(spark, sf_dir):
    """(x − mean) / population std on the cleaned lines (the GMM input)."""
    df = cleaned_sales(spark, sf_dir).select(*ORDER_KEYS, "Quantity", "UnitPrice")
    return rounded(sc.scale(df, ["Quantity", "UnitPrice"], "standard"))


def _batched_sql(body: str, *ctes: str) -> str:
    return with_sales(
        f"ix AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_idx FROM sales)",
        f"bt AS (SELECT *, CAST(floor(row_idx / {BATCH_SIZE}) + 1 AS INTEGER) AS batch_number FROM ix)",
        *ctes) + body


_T2_COLS = ["Quantity", "UnitPrice", "CustomerID"]


@query("standardize_per_batch", _batched_sql(
    "SELECT row_idx, batch_number, " + ", ".join(
        f"{r(f'({c} - avg({c}) OVER w) / CASE WHEN coalesce(stddev_pop({c}) OVER w, 0) = 0 THEN 1 ELSE stddev_pop({c}) OVER w END')} AS {c}"
        for c in _T2_COLS)
    + " FROM nn WINDOW w AS (PARTITION BY batch_number)",
    "nn AS (SELECT * FROM bt WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL AND CustomerID IS NOT NULL)"))
def q_standardize_per_batch(spark, sf_dir):
    """T1 per batch (DBSCAN type 2 input): batches of 50,000 raw lines, rows
    missing a feature dropped, each batch standardised on its own."""
    s = with_batches(with_row_index(sales_from_tables(spark, sf_dir), ORDER_KEYS), BATCH_SIZE)
    s = cl.drop_missing(s, _T2_COLS).select("row_idx", "batch_number",
                                            *[F.col(c).cast("double").alias(c) for c in _T2_COLS])
    return rounded(sc.scale(s, _T2_COLS, "standard", keys=["batch_number"]))


_T1_FEATS = ["Quantity", "UnitPrice", "CustomerID", "DaysSinceFirstPurchase"]


@query("minmax_per_batch", _batched_sql(
    "SELECT row_idx, batch_number, " + ", ".join(
        f"{r(f'({c} - min({c}) OVER w) / CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1 ELSE max({c}) OVER w - min({c}) OVER w END')} AS {c}"
        for c in _T1_FEATS)
    + " FROM nn WINDOW w AS (PARTITION BY batch_number)",
    "dd AS (SELECT *, CAST(floor((epoch(InvoiceDate) - epoch(min(InvoiceDate) OVER (PARTITION BY batch_number))) / 86400) AS BIGINT) AS DaysSinceFirstPurchase FROM bt)",
    "nn AS (SELECT * FROM dd WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL AND CustomerID IS NOT NULL AND DaysSinceFirstPurchase IS NOT NULL)"))
def q_minmax_per_batch(spark, sf_dir):
    """T2 per batch (DBSCAN type 1 input): days since the batch's first
    purchase, four features, rows with a gap dropped, min-max per batch."""
    from pyspark.sql import Window

    from tillpoint.functions.dates import days_since_group_min
    s = with_batches(with_row_index(sales_from_tables(spark, sf_dir), ORDER_KEYS), BATCH_SIZE)
    s = s.withColumn("DaysSinceFirstPurchase",
                     days_since_group_min(F.col("InvoiceDate"), Window.partitionBy("batch_number")))
    s = cl.drop_missing(s, _T1_FEATS).select("row_idx", "batch_number",
                                             *[F.col(c).cast("double").alias(c) for c in _T1_FEATS])
    return rounded(sc.scale(s, _T1_FEATS, "minmax", keys=["batch_number"]))


@query("robust_daily", with_sales(*CLEAN_CTES, _DAILY,
    "q AS (SELECT quantile_cont(Sales, 0.5) AS med, quantile_cont(Sales, 0.75) - quantile_cont(Sales, 0.25) AS iqr FROM d)")
    + f"SELECT Date, Sales, {r('(Sales - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END')} AS y FROM d, q")
def q_robust_daily(spark, sf_dir):
    """(Sales − median) / IQR on the daily series, fitted on all days."""
    daily = daily_cleaned(spark, sf_dir).withColumn("y", F.col("Sales"))
    return rounded(sc.scale(daily, ["y"], "robust"))


@query("minmax_train_test", with_sales(*CLEAN_CTES, _DAILY,
    f"""sp AS (SELECT *, CASE WHEN Date BETWEEN DATE '{TRAIN_RANGE[0]}' AND DATE '{TRAIN_RANGE[1]}' THEN 'train'
                     WHEN Date BETWEEN DATE '{TEST_RANGE[0]}' AND DATE '{TEST_RANGE[1]}' THEN 'test' END AS split FROM d)""",
    "m AS (SELECT min(Sales) AS lo, max(Sales) - min(Sales) AS rg FROM sp WHERE split = 'train')")
    + f"SELECT Date, split, Sales, {r('(Sales - lo) / CASE WHEN rg = 0 THEN 1 ELSE rg END')} AS scaled, "
      f"{r('Sales', 2)} AS restored FROM sp, m WHERE split IS NOT NULL")
def q_minmax_train_test(spark, sf_dir):
    """F10 + T2 + T4: day ranges, min-max fitted on train only and applied to
    both sides (test may leave [0, 1]); the inverse restores the input."""
    daily = cut_lineage(daily_cleaned(spark, sf_dir))
    sp = split_date_ranges(daily, "Date", TRAIN_RANGE, TEST_RANGE).withColumn("scaled", F.col("Sales"))
    params = sc.fit_scaler(sp.where("split = 'train'"), ["scaled"], "minmax")
    scaled = sc.apply_scaler(sp, params, ["scaled"])
    back = sc.inverse_scaler(scaled.withColumn("restored", F.col("scaled")),
                             params.withColumnsRenamed({"scaled_center": "restored_center",
                                                        "scaled_scale": "restored_scale"}),
                             ["restored"])
    out = rounded(back.select("Date", "split", "Sales", "scaled"))
    return out.join(rounded(back.select("Date", "restored"), 2), "Date")


@query("label_codes_stock", with_sales(*CLEAN_CTES) + f"""
SELECT {KEYS_SQL}, StockCode, CAST(dense_rank() OVER (ORDER BY StockCode) - 1 AS INTEGER) AS StockCode_encoded
FROM clean""")
def q_label_codes_stock(spark, sf_dir):
    """T5: StockCode → 0-based code by sorted distinct value."""
    df = cleaned_sales(spark, sf_dir).select(*ORDER_KEYS, "StockCode")
    return enc.label_codes(df, "StockCode")


@query("one_hot_country", with_sales() + f"""
SELECT {KEYS_SQL}, 'Country_' || Country AS dummy, 1 AS value
FROM sales WHERE Country <> (SELECT min(Country) FROM sales)""")
def q_one_hot_country(spark, sf_dir):
    """get_dummies(drop_first=True) on Country, shown in long form (the
    non-zero dummy cells) so the check does not depend on the category list."""
    df = sales_from_tables(spark, sf_dir).select(*ORDER_KEYS, "Country")
    wide = enc.one_hot(df, "Country")
    dummies = [c for c in wide.columns if c.startswith("Country_")]
    stack = ", ".join(f"'{c}', `{c}`" for c in dummies)
    long = wide.selectExpr(*ORDER_KEYS, f"stack({len(dummies)}, {stack}) AS (dummy, value)")
    return long.where("value = 1")


_PCA_CTES = [
    "st AS (SELECT avg(Quantity) AS mq, stddev_pop(Quantity) AS sq, avg(UnitPrice) AS mp, stddev_pop(UnitPrice) AS sp FROM clean)",
    f"z AS (SELECT {KEYS_SQL}, (Quantity - mq) / sq AS z1, (UnitPrice - mp) / sp AS z2 FROM clean, st)",
    "c AS (SELECT sign(corr(z1, z2)) AS s, abs(corr(z1, z2)) AS a FROM z)",
]


def standardized_pca_input(spark, sf_dir):
    """DBSCAN global step: drop id/text/date columns, numeric columns, standardise."""
    df = cleaned_sales(spark, sf_dir)
    num = cl.select_numeric(cl.drop_columns(
        df.select(*ORDER_KEYS, "InvoiceNo", "StockCode", "Description", "Quantity",
                  "UnitPrice", "CustomerID", "Country"),
        ["InvoiceNo", "Description", "CustomerID", "InvoiceDate", "Country"] + ORDER_KEYS[1:]))
    feats = num.columns
    keyed = df.select(*ORDER_KEYS, *feats)
    return sc.scale(keyed, feats, "standard"), feats


@query("pca_scores", with_sales(*CLEAN_CTES, *_PCA_CTES)
       + f"SELECT {KEYS_SQL}, {r('(z1 + s * z2) / sqrt(2)', 4)} AS pc1, {r('(z1 - s * z2) / sqrt(2)', 4)} AS pc2 FROM z, c")
def q_pca_scores(spark, sf_dir):
    """Two principal components of the standardised numeric columns
    (Quantity, UnitPrice), centred, largest loading positive."""
    z, feats = standardized_pca_input(spark, sf_dir)
    fit = fit_pca(z, feats, 2)
    # 4 digits: the eigenvectors agree with 1/√2 only to ~1e-12
    return rounded(fit.transform(z).select(*ORDER_KEYS, "pc1", "pc2"), 4)


@query("pca_variance", with_sales(*CLEAN_CTES, *_PCA_CTES) + f"""
SELECT 1 AS component, {r('(1 + a) / 2')} AS ratio FROM c
UNION ALL SELECT 2 AS component, {r('(1 - a) / 2')} AS ratio FROM c""")
def q_pca_variance(spark, sf_dir):
    """Explained variance ratio of the two components."""
    z, feats = standardized_pca_input(spark, sf_dir)
    fit = fit_pca(z, feats, 2)
    return rounded(fit.variance_frame(spark).select("component", "ratio"))


@query("split_sizes", with_sales(*CLEAN_CTES, _DAILY) + f"""
SELECT 'date_split' AS kind, 'train' AS split, count(*) AS rows FROM d WHERE Date <= DATE '{SPLIT_DATE}'
UNION ALL SELECT 'date_split', 'test', count(*) FROM d WHERE Date > DATE '{SPLIT_DATE}'
UNION ALL SELECT 'date_split_overlap', 'train', count(*) FROM d WHERE Date <= DATE '{SPLIT_DATE}'
UNION ALL SELECT 'date_split_overlap', 'test', count(*) FROM d WHERE Date >= DATE '{SPLIT_DATE}'
UNION ALL SELECT 'timestamp_closed', split, count(*) FROM (
  SELECT CASE WHEN InvoiceDate BETWEEN TIMESTAMP '{TRAIN_RANGE[0]}' AND TIMESTAMP '{TRAIN_RANGE[1]}' THEN 'train'
              WHEN InvoiceDate BETWEEN TIMESTAMP '{TEST_RANGE[0]}' AND TIMESTAMP '{TEST_RANGE[1]}' THEN 'test' END AS split
  FROM clean) WHERE split IS NOT NULL GROUP BY split
UNION ALL SELECT 'timestamp_half_open', split, count(*) FROM (
  SELECT CASE WHEN InvoiceDate >= TIMESTAMP '{TRAIN_RANGE[0]}' AND InvoiceDate < TIMESTAMP '{TRAIN_RANGE[1]}' + INTERVAL 1 DAY THEN 'train'
              WHEN InvoiceDate >= TIMESTAMP '{TEST_RANGE[0]}' AND InvoiceDate < TIMESTAMP '{TEST_RANGE[1]}' + INTERVAL 1 DAY THEN 'test' END AS split
  FROM clean) WHERE split IS NOT NULL GROUP BY split""")
def q_split_sizes(spark, sf_dir):
    """P5 over F9 (with and without the shared split day, B3) and F11 (closed
    midnight bounds with the hole, B7, and half-open day ranges)."""
    clean = cleaned_lines(spark, sf_dir, ["InvoiceDate", "Quantity", "UnitPrice"])
    daily = cut_lineage(agg.daily_sales(clean))
    parts = {
        "date_split": split_at_date(daily, "Date", SPLIT_DATE),
        "date_split_overlap": split_at_date(daily, "Date", SPLIT_DATE, overlap=True),
        "timestamp_closed": split_timestamp_ranges(clean, "InvoiceDate", TRAIN_RANGE, TEST_RANGE, closed=True),
        "timestamp_half_open": split_timestamp_ranges(clean, "InvoiceDate", TRAIN_RANGE, TEST_RANGE),
    }
    out = None
    for kind, d in parts.items():
        g = d.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(kind).alias("kind"), "split", "rows")
        out = g if out is None else out.unionByName(g)
    return out

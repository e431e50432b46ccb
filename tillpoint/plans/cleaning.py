"""Registered queries: sources, profiling, filters, outliers, daily sales (§2.1–2.6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators import aggregates as agg
from tillpoint.operators import cleaning as cl
from tillpoint.operators import outliers as ol
from tillpoint.operators import profile as pf
from tillpoint.plans.common import (CLEAN_CTES, EXTRA_KEYS_SQL, IQR_FACTOR, KEYS_SQL, OUTLIER_COLS,
                                    THRESHOLD_T, r, rounded, with_sales)
from tillpoint.plans.registry import query
from tillpoint.session import scratch_path, shuffles_released
from tillpoint.sources.sales import (EXTRA_KEYS, ORDER_KEYS, SALES_COLUMNS, SALES_SCHEMA, SHARES,
                                     read_sales_csv, sales_from_tables, sales_lines, write_csv)


def cleaned_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning job (§3.1): F1 then chained O2 on Quantity, UnitPrice."""
    return cleaned(sales_from_tables(spark, sf_dir))


def cleaned_lines(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The rows of ``cleaned_sales`` with ``columns`` alone, which the chained rule caches; in no fixed layout."""
    wanted = [*OUTLIER_COLS, *[c for c in columns if c not in OUTLIER_COLS]]
    return cleaned(sales_lines(spark, sf_dir, wanted)).select(*columns)


def daily_cleaned(spark: SparkSession, sf_dir: str, keys: list[str] | None = None, fill_days: bool = False) -> DataFrame:
    """A1 of ``cleaned_sales``."""
    lines = cleaned_lines(spark, sf_dir, [*(keys or []), "InvoiceDate", "Quantity", "UnitPrice"])
    return agg.daily_sales(lines, keys=keys, fill_days=fill_days)


def cleaned(sales: DataFrame) -> DataFrame:
    """The cleaning job on rows that have its columns."""
    return ol.remove_by_threshold(cl.keep_non_negative(sales), OUTLIER_COLS,
                                  threshold=THRESHOLD_T, mode="chained")


# ---------------------------------------------------------------- flagship
@query("daily_sales_clean", with_sales(*CLEAN_CTES) + """
SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales
FROM clean GROUP BY 1""")
def q_daily_sales_clean(spark, sf_dir):
    """Sales view → F1 → O2 (chained, t = 1.5) → A1 daily sales."""
    return daily_cleaned(spark, sf_dir)


# ---------------------------------------------------------------- sources
_BUSINESS_SQL = "InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country"


@query("sales_table", with_sales() + f"SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL} FROM sales")
def q_sales_table(spark, sf_dir):
    """The invoice-line table handed from cleaning to the models."""
    return sales_from_tables(spark, sf_dir)


@query("sales_csv_roundtrip", with_sales() + f"SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL} FROM sales")
def q_sales_csv_roundtrip(spark, sf_dir):
    """S4 then S1/S2: write headered CSV (retail ``M/d/yyyy H:mm`` dates), read it
    back with the declared schema and the lenient date parser."""
    path = scratch_path(spark, f"sales_csv_{uuid.uuid4().hex}")
    sales = sales_from_tables(spark, sf_dir)
    text = sales.withColumn("InvoiceDate", F.date_format("InvoiceDate", "M/d/yyyy H:mm"))
    write_csv(text, path)
    key_fields = [T.StructField(k, sales.schema[k].dataType, True) for k in EXTRA_KEYS]
    schema = T.StructType(SALES_SCHEMA.fields + key_fields)
    return read_sales_csv(spark, path, encoding="latin1", schema=schema)


@query("sales_csv_float_ids", with_sales() + f"SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL}, 0::BIGINT AS n_malformed FROM sales")
def q_sales_csv_float_ids(spark, sf_dir):
    """Customer ids with gaps, written as floats (``17850.0``) and quoted line feeds allowed, come back whole.
    A file is read by one task in any case, so it is compressed."""
    path = scratch_path(spark, f"sales_csv_{uuid.uuid4().hex}")
    for share in range(SHARES):
        sales = sales_lines(spark, sf_dir, share=share)
        with shuffles_released(spark):
            write_csv(sales.withColumns({"CustomerID": F.col("CustomerID").cast("double"),
                                         "InvoiceDate": F.date_format("InvoiceDate", "M/d/yyyy H:mm")}), path, "append", "gzip")
    key_fields = [T.StructField(k, sales.schema[k].dataType, True) for k in EXTRA_KEYS]
    back = read_sales_csv(spark, path, schema=T.StructType(SALES_SCHEMA.fields + key_fields), multi_line=True, malformed="_bad")
    return back.withColumn("n_malformed", F.size("_bad").cast("long")).drop("_bad")


# ---------------------------------------------------------------- profiling
_PROFILE_COLS = ["Quantity", "UnitPrice", "CustomerID"]


def _stages(spark, sf_dir):
    raw = sales_from_tables(spark, sf_dir)
    return {"raw": raw, "clean": cleaned_sales(spark, sf_dir)}


def _describe_sql(src: str, stage: str) -> str:
    parts = []
    for c in _PROFILE_COLS:
        parts.append(f"""SELECT '{stage}' AS stage, '{c}' AS "column", count({c}) AS count,
  {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
  {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50,
  {r(f'quantile_cont({c}, 0.75)')} AS p75, {r(f'max({c})')} AS max FROM {src}""")
    return "\nUNION ALL\n".join(parts)


@query("profile_describe", with_sales(*CLEAN_CTES)
       + _describe_sql("sales", "raw") + "\nUNION ALL\n" + _describe_sql("clean", "clean"))
def q_profile_describe(spark, sf_dir):
    """P2 + P6: describe before and after cleaning."""
    raw = sales_from_tables(spark, sf_dir).select(*_PROFILE_COLS).persist()  # both stages from one join
    return rounded(pf.profile_stages({"raw": raw, "clean": cleaned(raw)}, _PROFILE_COLS, kinds=["describe"])["describe"])


def _nulls_sql(src: str, stage: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{stage}' AS stage, '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM {src}"
        for c in SALES_COLUMNS + EXTRA_KEYS)


@query("profile_nulls", with_sales(*CLEAN_CTES)
       + _nulls_sql("sales", "raw") + "\nUNION ALL\n" + _nulls_sql("clean", "clean"))
def q_profile_nulls(spark, sf_dir):
    """P3 + P6: missing values per column before and after cleaning."""
    return pf.profile_stages(_stages(spark, sf_dir), kinds=["nulls"])["nulls"]


@query("profile_negatives", with_sales(*CLEAN_CTES) + """
SELECT 'raw' AS stage, CAST(count_if(Quantity < 0 OR UnitPrice < 0) AS BIGINT) AS negatives FROM sales
UNION ALL
SELECT 'clean' AS stage, CAST(count_if(Quantity < 0 OR UnitPrice < 0) AS BIGINT) AS negatives FROM clean""")
def q_profile_negatives(spark, sf_dir):
    """P4 + P6."""
    return pf.profile_stages(_stages(spark, sf_dir), kinds=["negatives"])["negatives"]


@query("sales_head", with_sales() + f"""
SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL} FROM sales ORDER BY {KEYS_SQL} LIMIT 5""")
def q_sales_head(spark, sf_dir):
    """``df.head()`` in key order (a top-k, the limit is the feature)."""
    return pf.head(sales_from_tables(spark, sf_dir), ORDER_KEYS, 5)


# ---------------------------------------------------------------- filters & outliers
_NARROW = ["InvoiceNo", "Quantity", "UnitPrice"] + ORDER_KEYS
_NARROW_SQL = ", ".join(_NARROW)


@query("filter_non_negative", with_sales() + f"""
SELECT {_NARROW_SQL} FROM sales WHERE Quantity >= 0 AND UnitPrice >= 0""")
def q_filter_non_negative(spark, sf_dir):
    """F1."""
    return cl.keep_non_negative(sales_from_tables(spark, sf_dir)).select(*_NARROW)


def _quartile_cte(prev: str, c: str, name: str) -> list[str]:
    return [
        f"q_{name} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {prev})",
        f"{name} AS (SELECT {prev}.* FROM {prev}, q_{name} WHERE {c} BETWEEN "
        f"q1 - {IQR_FACTOR} * (q3 - q1) AND q3 + {IQR_FACTOR} * (q3 - q1))",
    ]


@query("outliers_quartiles", with_sales(
    "f1 AS (SELECT * FROM sales WHERE Quantity >= 0 AND UnitPrice >= 0)",
    *_quartile_cte("f1", "Quantity", "o1"), *_quartile_cte("o1", "UnitPrice", "o2"))
    + f"SELECT {_NARROW_SQL} FROM o2")
def q_outliers_quartiles(spark, sf_dir):
    """O1 chained (IQR factor 0.25) after F1."""
    df = cl.keep_non_negative(sales_from_tables(spark, sf_dir))
    return ol.remove_by_quartiles(df, OUTLIER_COLS, factor=IQR_FACTOR, mode="chained").select(*_NARROW)


@query("outliers_threshold_first", with_sales(*CLEAN_CTES[:3]) + f"SELECT {_NARROW_SQL} FROM s1")
def q_outliers_threshold_first(spark, sf_dir):
    """O2 ``mode='first'``: only the first column is treated (the original loop)."""
    df = cl.keep_non_negative(sales_from_tables(spark, sf_dir))
    return ol.remove_by_threshold(df, OUTLIER_COLS, THRESHOLD_T, mode="first").select(*_NARROW)


@query("outliers_threshold_joint", with_sales(
    "f1 AS (SELECT * FROM sales WHERE Quantity >= 0 AND UnitPrice >= 0)",
    f"""b AS (SELECT avg(Quantity) - {THRESHOLD_T} * stddev_samp(Quantity) AS qlo,
                     avg(Quantity) + {THRESHOLD_T} * stddev_samp(Quantity) AS qhi,
                     avg(UnitPrice) - {THRESHOLD_T} * stddev_samp(UnitPrice) AS plo,
                     avg(UnitPrice) + {THRESHOLD_T} * stddev_samp(UnitPrice) AS phi FROM f1)""")
    + f"SELECT {_NARROW_SQL} FROM f1, b WHERE Quantity BETWEEN qlo AND qhi AND UnitPrice BETWEEN plo AND phi")
def q_outliers_threshold_joint(spark, sf_dir):
    """O2 ``mode='joint'``: all bounds from the input, applied together."""
    df = cl.keep_non_negative(sales_from_tables(spark, sf_dir))
    return ol.remove_by_threshold(df, OUTLIER_COLS, THRESHOLD_T, mode="joint").select(*_NARROW)


@query("clean_rows", with_sales(*CLEAN_CTES) + f"SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL} FROM clean")
def q_clean_rows(spark, sf_dir):
    """§3.1 cleaning output (F1 + chained O2), the table every model reads."""
    return cleaned_sales(spark, sf_dir)


@query("drop_missing_subset", with_sales() + f"""
SELECT {_BUSINESS_SQL}, {EXTRA_KEYS_SQL} FROM sales
WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL AND CustomerID IS NOT NULL""")
def q_drop_missing_subset(spark, sf_dir):
    """drop rows missing Quantity, UnitPrice or CustomerID, keep all columns."""
    return cl.drop_missing(sales_from_tables(spark, sf_dir), ["Quantity", "UnitPrice", "CustomerID"])


@query("numeric_after_drop", with_sales() + """
SELECT Quantity, UnitPrice FROM sales WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL""")
def q_numeric_after_drop(spark, sf_dir):
    """F3 + F4 + F5: drop the id/text/date columns, keep numeric ones, drop missing."""
    df = sales_from_tables(spark, sf_dir, with_keys=False)
    df = cl.drop_columns(df, ["InvoiceNo", "Description", "CustomerID", "InvoiceDate", "Country"])
    return cl.drop_missing(cl.select_numeric(df))

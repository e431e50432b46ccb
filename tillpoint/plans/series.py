"""Registered queries: dates, per-day features, row index, batches, windows (§2.5–2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillpoint.functions import dates as dt
from tillpoint.operators import aggregates as agg
from tillpoint.operators import windows as win
from tillpoint.operators.rowindex import with_batches, with_row_index
from tillpoint.plans.cleaning import cleaned_lines, daily_cleaned
from tillpoint.plans.common import CLEAN_CTES, KEYS_SQL, r, rounded, with_sales
from tillpoint.plans.registry import query
from tillpoint.sources.sales import ORDER_KEYS, sales_from_tables

# Fixed value: rows per batch of the batched clustering jobs.
BATCH_SIZE = 50_000
SEQ_LEN = 30
LAGS = list(range(1, 13))
_FEATURE_COLS = ["InvoiceDate", "InvoiceNo", "Quantity", "UnitPrice"]


@query("dates_parsed", with_sales() + f"""
SELECT {KEYS_SQL},
  CASE WHEN l_linenumber = 7 THEN NULL ELSE InvoiceDate END AS parsed_lenient,
  InvoiceDate AS parsed_strict,
  CAST(InvoiceDate AS DATE) AS Date,
  isodow(InvoiceDate) - 1 AS day_of_week
FROM sales""")
def q_dates_parsed(spark, sf_dir):
    """D1 strict parse of ``M/d/yyyy H:mm`` text; D2 lenient parse of mixed
    layouts with junk (→ NULL); D3 date; D5 weekday with Monday = 0."""
    s = sales_from_tables(spark, sf_dir)
    retail = F.date_format("InvoiceDate", "M/d/yyyy H:mm")
    mixed = (F.when(F.col("l_linenumber") == 7, F.lit("not a date"))
              .when(F.col("l_linenumber") % 2 == 0, F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
              .otherwise(retail))
    return s.select(*ORDER_KEYS,
                    dt.parse_timestamp_lenient(mixed).alias("parsed_lenient"),
                    dt.parse_timestamp_strict(retail, "M/d/yyyy H:mm").alias("parsed_strict"),
                    dt.to_day(F.col("InvoiceDate")).alias("Date"),
                    dt.weekday_monday0(F.col("InvoiceDate")).alias("day_of_week"))


def _features_sql(key: str) -> str:
    return with_sales(*CLEAN_CTES) + f"""
SELECT {key} AS InvoiceDate,
  CAST(sum(CASE WHEN Quantity > 0 THEN Quantity ELSE 0 END) AS BIGINT) AS daily,
  count(DISTINCT InvoiceNo) AS daily_sells,
  {r('sum(CASE WHEN Quantity * UnitPrice > 0 THEN Quantity * UnitPrice ELSE 0 END)', 4)} AS daily_total,
  isodow({key}) - 1 AS day_of_week
FROM clean GROUP BY 1"""


@query("daily_features_timestamp", _features_sql("InvoiceDate"))
def q_daily_features_timestamp(spark, sf_dir):
    """A2–A5 per full timestamp (the original grain, B6)."""
    return rounded(agg.daily_features(cleaned_lines(spark, sf_dir, _FEATURE_COLS), grain="timestamp"), 4)


@query("daily_features_day", _features_sql("CAST(CAST(InvoiceDate AS DATE) AS TIMESTAMP)"))
def q_daily_features_day(spark, sf_dir):
    """A2–A5 per calendar day (default grain)."""
    return rounded(agg.daily_features(cleaned_lines(spark, sf_dir, _FEATURE_COLS), grain="day"), 4)


@query("daily_sales_filled", with_sales(*CLEAN_CTES,
    "d AS (SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales FROM clean GROUP BY 1)",
    "g AS (SELECT CAST(unnest(generate_series(min(Date), max(Date), INTERVAL 1 DAY)) AS DATE) AS Date FROM d)")
    + "SELECT g.Date, coalesce(d.Sales, 0.0) AS Sales FROM g LEFT JOIN d USING (Date)")
def q_daily_sales_filled(spark, sf_dir):
    """A1 with ``fill_days=True`` (B18): days without sales appear with 0."""
    return daily_cleaned(spark, sf_dir, fill_days=True)


@query("daily_sales_by_country", with_sales(*CLEAN_CTES) + """
SELECT Country, CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales
FROM clean GROUP BY 1, 2""")
def q_daily_sales_by_country(spark, sf_dir):
    """A1 with a series key: one daily series per country."""
    return daily_cleaned(spark, sf_dir, keys=["Country"])


@query("row_index", with_sales() + f"""
SELECT row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_idx, {KEYS_SQL} FROM sales""")
def q_row_index(spark, sf_dir):
    """Dense row position in key order, without a one-partition window."""
    s = sales_from_tables(spark, sf_dir).select(*ORDER_KEYS)
    return with_row_index(s, ORDER_KEYS).select("row_idx", *ORDER_KEYS)


def _batch_sql(body: str) -> str:
    return with_sales(f"""ix AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_idx FROM sales)""",
                      f"bt AS (SELECT *, CAST(floor(row_idx / {BATCH_SIZE}) + 1 AS INTEGER) AS batch_number FROM ix)") + body


@query("batch_days_since_first", _batch_sql("""
SELECT row_idx, batch_number,
  CAST(floor((epoch(InvoiceDate) - epoch(min(InvoiceDate) OVER (PARTITION BY batch_number))) / 86400) AS BIGINT)
    AS DaysSinceFirstPurchase
FROM bt"""))
def q_batch_days_since_first(spark, sf_dir):
    """S3 + F14 + W2 + D4: batch numbers from 1 and whole days since the batch's
    earliest timestamp (the batched DBSCAN type-1 feature)."""
    s = sales_from_tables(spark, sf_dir)
    b = with_batches(with_row_index(s, ORDER_KEYS), BATCH_SIZE)
    w = Window.partitionBy("batch_number")
    return b.select("row_idx", "batch_number",
                    dt.days_since_group_min(F.col("InvoiceDate"), w).alias("DaysSinceFirstPurchase"))


@query("batch_summary", _batch_sql("""
SELECT batch_number, count(*) AS rows, min(row_idx) AS first_row, max(row_idx) AS last_row,
  count(CustomerID) AS with_customer, min(InvoiceDate) AS first_date
FROM bt GROUP BY 1"""))
def q_batch_summary(spark, sf_dir):
    """The batches the chunked reader would produce, one row each."""
    s = sales_from_tables(spark, sf_dir)
    b = with_batches(with_row_index(s, ORDER_KEYS, keep=["CustomerID", "InvoiceDate"]), BATCH_SIZE)
    return b.groupBy("batch_number").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_idx").alias("first_row"),
        F.max("row_idx").alias("last_row"), F.count("CustomerID").alias("with_customer"),
        F.min("InvoiceDate").alias("first_date"))


def daily_clean_indexed(spark, sf_dir):
    daily = daily_cleaned(spark, sf_dir)
    return win.add_position(daily, "Date", [], "pos")


_DAILY_POS = with_sales(*CLEAN_CTES,
    "d AS (SELECT CAST(InvoiceDate AS DATE) AS Date, round_even(sum(Quantity * UnitPrice), 2) AS Sales FROM clean GROUP BY 1)",
    "p AS (SELECT Date, Sales, row_number() OVER (ORDER BY Date) - 1 AS pos FROM d)")


@query("sequences_long", _DAILY_POS + f"""
SELECT t.Date, t.Sales AS target, k.i AS step, s.Sales AS value
FROM p t, range({SEQ_LEN}) k(i), p s
WHERE t.pos >= {SEQ_LEN} AND s.pos = t.pos - {SEQ_LEN} + k.i""")
def q_sequences_long(spark, sf_dir):
    """30-day input windows with the next day as target, in long form
    (one row per target date and step)."""
    seq = win.sliding_sequences(daily_clean_indexed(spark, sf_dir), "Sales", SEQ_LEN, "pos", block=500)
    return seq.select("Date", "target", F.posexplode("sequence").alias("step", "value")) \
              .withColumn("step", F.col("step").cast("bigint"))


@query("lag_features", _DAILY_POS + "SELECT Date, Sales, " + ", ".join(
    f"lag(Sales, {i}) OVER (ORDER BY pos) AS lag_{i}" for i in LAGS)
    + ", round(Sales - lag(Sales, 1) OVER (ORDER BY pos), 2) AS diff_1 FROM p")
def q_lag_features(spark, sf_dir):
    """Lags 1…12 and the first difference of the daily series (ARIMA inputs)."""
    out = win.lag_columns(daily_clean_indexed(spark, sf_dir), "Sales", LAGS, "pos", block=500)
    return rounded(out.drop("pos"), 2)

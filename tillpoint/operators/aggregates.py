"""Aggregations.

All are hash aggregations with a partial (map-side) step, so a hot key
(one date holding a third of the rows) is combined before the shuffle and
never reaches one reducer as raw rows. ``count_distinct`` is planned by
Spark as an aggregation on (key, value) first, which also splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.dates import weekday_monday0
from tillpoint.functions.numeric import line_amount, round_half_even
from tillpoint.operators.quantiles import exact_quantiles


def daily_sales(df: DataFrame, ts_col: str = "InvoiceDate", keys: list[str] | None = None,
                qty: str = "Quantity", price: str = "UnitPrice",
                fill_days: bool = False) -> DataFrame:
    """A1: Σ(Quantity·UnitPrice) per calendar date, rounded half-even to 2 decimals.

    ``keys`` adds series keys (Country, StockCode …) for many series at once.
    ``fill_days`` inserts missing days with Sales 0 (B18), per series.
    """
    keys = list(keys or [])
    daily = (df.groupBy(*keys, F.to_date(ts_col).alias("Date"))
               .agg(round_half_even(F.sum(line_amount(qty, price))).alias("Sales")))
    if fill_days:
        span = daily.groupBy(*keys).agg(F.min("Date").alias("_a"), F.max("Date").alias("_b"))
        grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("Date"))
        daily = (grid.join(daily, keys + ["Date"], "left")
                     .withColumn("Sales", F.coalesce("Sales", F.lit(0.0))))
    return daily


def daily_features(df: DataFrame, grain: str = "day", ts_col: str = "InvoiceDate",
                   qty: str = "Quantity", price: str = "UnitPrice",
                   invoice: str = "InvoiceNo") -> DataFrame:
    """A2–A5: per key, Σ positive Quantity, distinct invoices, Σ positive amount, weekday.

    ``grain='timestamp'`` groups by the full timestamp (what the original
    does, B6); ``grain='day'`` by calendar date. The key column keeps the
    name ``InvoiceDate``; weekday is a function of the key (A5).
    """
    if grain == "timestamp":
        key = F.col(ts_col).alias("InvoiceDate")
    elif grain == "day":
        key = F.to_timestamp_ntz(F.to_date(ts_col)).alias("InvoiceDate")
    else:
        raise ValueError("grain must be 'timestamp' or 'day'")
    amount = line_amount(qty, price)
    return (df.groupBy(key).agg(
        F.sum(F.when(F.col(qty) > 0, F.col(qty)).otherwise(F.lit(0))).cast("bigint").alias("daily"),
        F.count_distinct(invoice).alias("daily_sells"),
        F.sum(F.when(amount > 0, amount).otherwise(F.lit(0.0))).alias("daily_total"))
        .withColumn("day_of_week", weekday_monday0(F.col("InvoiceDate"))))


def cluster_profile(df: DataFrame, cluster_col: str = "cluster",
                    cols=("Quantity", "UnitPrice")) -> DataFrame:
    """Mean, median (exact), sample std, min, max of each column per cluster."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    base = df.groupBy(cluster_col).agg(*aggs)
    med = exact_quantiles(df, cols, [0.5], group_cols=[cluster_col]).groupBy(cluster_col).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}_median") for c in cols])
    ordered = [cluster_col] + [f"{c}_{s}" for c in cols
                               for s in ("mean", "median", "std", "min", "max")]
    return base.join(med, cluster_col, "left").select(*ordered)


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Rows per cluster, largest first (``value_counts``)."""
    return (df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), cluster_col))


def cluster_summary(df: DataFrame, cluster_col: str = "Cluster",
                    keys: list[str] | None = None) -> DataFrame:
    """Per cluster without noise — Quantity mean/min/max/count, UnitPrice
    mean/min/max, distinct customers. ``keys`` (e.g. ``batch_number``) keeps
    batch-local labels apart (B9)."""
    by = [*(keys or []), cluster_col]
    kept = df.where(F.col(cluster_col) != -1)
    out = kept.groupBy(*by).agg(F.avg("Quantity").alias("Quantity_mean"),
                                F.min("Quantity").alias("Quantity_min"),
                                F.max("Quantity").alias("Quantity_max"),
                                F.count("Quantity").alias("Quantity_count"),
                                F.avg("UnitPrice").alias("UnitPrice_mean"),
                                F.min("UnitPrice").alias("UnitPrice_min"),
                                F.max("UnitPrice").alias("UnitPrice_max"))
    # counted apart: beside the others, every (cluster, customer) would be exchanged with all their partial sums
    seen = kept.where(F.col("CustomerID").isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in by], "CustomerID").distinct() \
               .groupBy(*[f"_{c}" for c in by]).agg(F.count(F.lit(1)).alias("_n"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return out.join(seen, same, "left").select(*out.columns, F.coalesce("_n", F.lit(0)).alias("CustomerID_nunique"))


def country_cluster_counts(df: DataFrame, cluster_col: str = "Cluster",
                           keys: list[str] | None = None, labels: list[int] | None = None,
                           wide: bool = False, filled: bool = False) -> DataFrame:
    """Country × Cluster row counts. Long form by default (any number of
    labels); ``filled`` adds the zero cells of the table (every country with every
    label of the same ``keys``), ``wide=True`` pivots to one column per label, zero-filled."""
    keys = list(keys or [])
    long = (df.groupBy("Country", *keys, cluster_col)
              .agg(F.count(F.lit(1)).alias("count")))
    if filled and not wide:
        seen = long.groupBy(*keys).agg(F.collect_set(cluster_col).alias("_labels"))
        rows = long.select("Country", *keys).distinct()
        grid = (rows.join(seen, keys) if keys else rows.crossJoin(F.broadcast(seen))) \
            .select("Country", *keys, F.explode("_labels").alias(cluster_col))
        return grid.join(long, ["Country", *keys, cluster_col], "left") \
                   .select("Country", *keys, cluster_col, F.coalesce("count", F.lit(0)).alias("count"))
    if not wide:
        return long
    piv = (long.groupBy("Country", *keys)
               .pivot(cluster_col, labels).agg(F.first("count")))
    return piv.na.fill(0)


def cluster_counts(df: DataFrame, cluster_col: str = "Cluster",
                   keys: list[str] | None = None) -> DataFrame:
    """Number of clusters (noise excluded, B10) and noise rows."""
    keys = list(keys or [])
    label = F.col(cluster_col)
    return df.groupBy(*keys).agg(
        F.count_distinct(F.when(label != -1, label)).alias("n_clusters"),
        F.count_if(label == -1).alias("n_noise"))

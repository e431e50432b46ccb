"""Chart tables (C1–C9): the small tables behind each chart, computed in Spark.

Drawing is not done here; a scatter of millions of points becomes a 2-D
histogram per cluster (C3), series become long tables (C6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter_bins(df: DataFrame, x: str, y: str, width: float, height: float,
                 cluster_col: str | None = "Cluster", x_range=None, y_range=None) -> DataFrame:
    """C3 (+ F13): counts per (x bin, y bin, cluster); bins are
    [k·width, (k+1)·width). Optional zoom window, bounds inclusive."""
    if x_range is not None and y_range is not None:
        df = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    keys = [F.floor(F.col(x) / F.lit(width)).cast("long").alias("x_bin"),
            F.floor(F.col(y) / F.lit(height)).cast("long").alias("y_bin")]
    if cluster_col:
        keys.append(F.col(cluster_col))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def series_long(parts: dict[str, DataFrame], date_col: str, value_col: str,
                keys: list[str] | None = None) -> DataFrame:
    """Several series (train, test, predicted …) in one long table."""
    keys = list(keys or [])
    out = None
    for name, d in parts.items():
        t = d.select(*keys, F.col(date_col).alias("date"), F.lit(name).alias("series"),
                     F.col(value_col).cast("double").alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def residual_table(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Predicted value and residual (actual − predicted) per row."""
    return df.select(F.col(pred).alias("predicted"), (F.col(actual) - F.col(pred)).alias("residual"))

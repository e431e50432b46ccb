"""Shared pieces of the registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.sources.sales import ORDER_KEYS, SALES_SQL

# Parameters used by the registered queries (the driver's tables are close to
# uniform, so the reference's t = 20 and 1.5·IQR would remove nothing; see
# FIXTURES.md §B "Thresholds").
THRESHOLD_T = 1.5
IQR_FACTOR = 0.25
OUTLIER_COLS = ["Quantity", "UnitPrice"]
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so engines that sum in a different order agree."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def with_sales(*ctes: str) -> str:
    """``WITH sales AS (…), <ctes>`` prefix for oracle SQL."""
    body = ",\n".join(["sales AS (" + SALES_SQL + ")"] + list(ctes))
    return "WITH " + body + "\n"


KEYS_SQL = ", ".join(ORDER_KEYS)
EXTRA_KEYS_SQL = ", ".join(ORDER_KEYS[1:])

# DuckDB twin of keep_non_negative + chained mean ± t·std on Quantity then UnitPrice.
CLEAN_CTES = [
    "f1 AS (SELECT * FROM sales WHERE Quantity >= 0 AND UnitPrice >= 0)",
    f"b1 AS (SELECT avg(Quantity) - {THRESHOLD_T} * stddev_samp(Quantity) AS lo, "
    f"avg(Quantity) + {THRESHOLD_T} * stddev_samp(Quantity) AS hi FROM f1)",
    "s1 AS (SELECT f1.* FROM f1, b1 WHERE Quantity BETWEEN lo AND hi)",
    f"b2 AS (SELECT avg(UnitPrice) - {THRESHOLD_T} * stddev_samp(UnitPrice) AS lo, "
    f"avg(UnitPrice) + {THRESHOLD_T} * stddev_samp(UnitPrice) AS hi FROM s1)",
    "clean AS (SELECT s1.* FROM s1, b2 WHERE UnitPrice BETWEEN lo AND hi)",
]


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL rounding twin of ``rounded``."""
    return f"round(CAST({expr} AS DOUBLE), {digits})"

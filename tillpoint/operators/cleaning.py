"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_non_negative(df: DataFrame, cols=("Quantity", "UnitPrice")) -> DataFrame:
    """keep rows where every column is ≥ 0; NULL/NaN rows drop too (as in pandas).

    ``NaN >= 0`` is true in Spark, so NaN is excluded explicitly.
    """
    cond = None
    for c in cols:
        dt = df.schema[c].dataType
        term = F.col(c) >= 0
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            term = term & ~F.isnan(c)
        cond = term if cond is None else cond & term
    return df.where(cond)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop the listed columns (missing names are ignored)."""
    return df.drop(*cols)


def numeric_columns(df: DataFrame) -> list[str]:
    """names of numeric columns, in schema order (``select_dtypes(np.number)``)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def _missing(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    m = F.col(c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        m = m | F.isnan(c)
    return m


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """drop rows with a NULL (or NaN) in any of ``subset`` (default: all columns)."""
    cols = subset or df.columns
    cond = None
    for c in cols:
        term = ~_missing(df, c)
        cond = term if cond is None else cond & term
    return df.where(cond) if cond is not None else df


# The zoom windows of the mixture-model charts.
ZOOM_SCALED = ((-0.5, 3.5), (0.0, 35.0))
ZOOM_PCA = ((-5.0, 5.0), (0.0, 20.0))

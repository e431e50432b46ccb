"""Numeric scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the division guard of the sequence model's percentage error.
MAPE_EPSILON = 1e-10


def round_half_even(c: Column, digits: int = 2) -> Column:
    """numpy/pandas ``round`` is half-to-even; Spark ``round`` is half-up."""
    return F.bround(c, digits)


def line_amount(qty: str = "Quantity", price: str = "UnitPrice") -> Column:
    """Quantity × UnitPrice (``profit`` / ``total_sales`` / ``total_price``)."""
    return F.col(qty) * F.col(price)


def guarded_abs(c: Column, eps: float = MAPE_EPSILON) -> Column:
    """max(|y|, eps)."""
    return F.greatest(F.abs(c), F.lit(eps))


def percent(num: Column, den: Column) -> Column:
    """100·num/den; a zero denominator gives NULL instead of an error."""
    return F.try_divide(num, den) * F.lit(100.0)

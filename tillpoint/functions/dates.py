"""Date and time scalar functions (D1–D5). All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layouts tried, in this order, by the lenient parser.
# ISO forms first, then the month/day/year layout of the retail CSV ("12/1/2010 8:26").
DEFAULT_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy",
]


def parse_timestamp_strict(c: Column, fmt: str | None = None) -> Column:
    """Text → timestamp_ntz; malformed text raises (ANSI mode) like ``pd.to_datetime``."""
    if fmt:
        return F.to_timestamp_ntz(c, F.lit(fmt))
    return F.to_timestamp_ntz(c)


def parse_timestamp_lenient(c: Column, fmt: str | list[str] | None = None) -> Column:
    """Text → timestamp_ntz, unparsable text → NULL (``errors='coerce'``).

    Tries each layout in turn; ``try_to_timestamp`` never raises.
    """
    formats = [fmt] if isinstance(fmt, str) else (fmt or DEFAULT_FORMATS)
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def to_day(c: Column) -> Column:
    """D3: timestamp → calendar date."""
    return F.to_date(c)


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (``Timedelta.days``, floor)."""
    return F.floor(F.timestamp_diff("SECOND", start, end) / F.lit(86400)).cast("bigint")


def days_since_group_min(ts: Column, window) -> Column:
    """D4 + W2: whole days since the earliest timestamp of the window's partition."""
    return whole_days_between(F.min(ts).over(window), ts)


def weekday_monday0(c: Column) -> Column:
    """Day of week with Monday = 0 (pandas ``.dayofweek``), not Spark's ``dayofweek``."""
    return F.weekday(c)

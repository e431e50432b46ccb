"""Train/test splits.

All splits return one DataFrame with a ``split`` column rather than
several frames, so a single scan serves every side and ``groupBy('split')``
gives the sizes (P5).
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ts(value) -> F.Column:
    return F.lit(value).cast("timestamp_ntz")


def split_at_date(df: DataFrame, date_col: str, split_date: str,
                  overlap: bool = False) -> DataFrame:
    """``train`` = on or before the split date; ``test`` = after it.

    ``overlap=True`` reproduces the original, where the split day is in both
    sets (B3): such rows appear twice, once per split.
    """
    d = F.col(date_col).cast("date")
    s = F.lit(split_date).cast("date")
    train = df.where(d <= s).withColumn("split", F.lit("train"))
    test = df.where((d >= s) if overlap else (d > s)).withColumn("split", F.lit("test"))
    return train.unionByName(test)


def split_date_ranges(df: DataFrame, date_col: str, train: tuple[str, str],
                      test: tuple[str, str]) -> DataFrame:
    """closed ranges of calendar days; rows in neither range are dropped."""
    d = F.col(date_col).cast("date")
    lab = (F.when(d.between(F.lit(train[0]).cast("date"), F.lit(train[1]).cast("date")), "train")
            .when(d.between(F.lit(test[0]).cast("date"), F.lit(test[1]).cast("date")), "test"))
    return df.withColumn("split", lab).where(F.col("split").isNotNull())


def split_timestamp_ranges(df: DataFrame, ts_col: str, train: tuple[str, str],
                           test: tuple[str, str], closed: bool = False) -> DataFrame:
    """ranges on a timestamp.

    ``closed=True`` is the original: bounds are midnight timestamps, both
    inclusive, so the rows after midnight on the last training day fall in
    neither set (B7). Default: half-open day ranges [first day, last day + 1).
    """
    t = F.col(ts_col)

    def rng(a: str, b: str):
        if closed:
            return t.between(_ts(a), _ts(b))
        end = (_dt.date.fromisoformat(b) + _dt.timedelta(days=1)).isoformat()
        return (t >= _ts(a)) & (t < _ts(end))

    lab = F.when(rng(*train), "train").when(rng(*test), "test")
    return df.withColumn("split", lab).where(F.col("split").isNotNull())


def random_holdout(df: DataFrame, key_cols: list[str], fraction: float = 0.2,
                   seed: int = 42, label: str = "val") -> DataFrame:
    """M8: the ceil(fraction·n) rows with the least seeded hashes of their key are ``label``, the rest ``train``.

    The hash that parts them is found by selection: rows below a bracket about its
    expected place are counted, the bracket's few hashes (about √n) are ordered. Rows are then
    labelled where they lie, without a sort or a shuffle. The split does not depend on
    partitioning, unlike ``randomSplit``; rows of equal keys stay together.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    n = df.count()
    n_val = int(math.ceil(fraction * n))
    if not 0 < n_val < n:
        return df.withColumn("split", F.lit(label if n_val else "train"))
    hashes = df.select(h.alias("_h"))
    at, spread = n_val / n, 6 * math.sqrt(n) + 64  # ranks that the place of a uniform hash may be off
    while True:
        low, high = (max(-(1 << 63), min((1 << 63) - 1, int((at + side * spread / n) * (1 << 64)) - (1 << 63))) for side in (-1, 1))
        below, inside = hashes.agg(F.count(F.when(F.col("_h") < low, 1)), F.count(F.when(F.col("_h").between(low, high), 1))).first()
        if below < n_val <= below + inside:
            break
        spread *= 8  # repeated keys
    last = hashes.where(F.col("_h").between(low, high)).groupBy("_h").count().select(
        "_h", F.sum("count").over(Window.orderBy("_h")).alias("_n")).where(F.col("_n") >= n_val - below).agg(F.min("_h")).first()[0]
    return df.withColumn("split", F.when(h <= F.lit(last), F.lit(label)).otherwise(F.lit("train")))

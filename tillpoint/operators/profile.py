"""Profiling (P1–P6): first rows, describe, nulls, negatives, before/after.

Every profile is one aggregate pass (partial aggregation before the
shuffle), returned in long form so several stages can be unioned.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators.cleaning import numeric_columns
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.session import cut_lineage


def head(df: DataFrame, order_keys, n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (a top-k, not a full sort)."""
    return df.orderBy(*order_keys).limit(n)


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 %, max per numeric column.

    Not ``DataFrame.summary()``: its percentiles are approximate.
    """
    cols = cols or numeric_columns(df)
    narrow = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)  # read once for the moments and the quantiles' passes
    moments = narrow.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                                    F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in cols])
    stats = cut_lineage(moments.select(F.explode(F.array(*cols)).alias("_s")).select("_s.*"), "checkpoint")
    q = exact_quantiles(narrow, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("p75"))
    narrow.unpersist()
    return stats.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing values per column (NULL, and NaN in floating columns)."""
    cols = cols or df.columns
    aggs = []
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        aggs.append(F.count_if(miss).alias(c))
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return one.selectExpr(f"stack({len(cols)}, {stack}) AS (column, nulls)")


def negative_count(df: DataFrame, cols=("Quantity", "UnitPrice")) -> DataFrame:
    """Rows with a negative value in any of ``cols``."""
    cond = None
    for c in cols:
        cond = (F.col(c) < 0) if cond is None else cond | (F.col(c) < 0)
    return df.agg(F.count_if(cond).alias("negatives"))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """P5: row count per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))


def profile_stages(stages: dict[str, DataFrame], cols: list[str] | None = None,
                   neg_cols=("Quantity", "UnitPrice"), kinds=("describe", "nulls", "negatives")) -> dict[str, DataFrame]:
    """P2–P4 (those of ``kinds``) for several stages (e.g. ``raw``/``clean``), each tagged with ``stage``."""
    out: dict[str, DataFrame] = {}
    for kind, fn in (("describe", lambda d: describe(d, cols)),
                     ("nulls", lambda d: null_counts(d)),
                     ("negatives", lambda d: negative_count(d, neg_cols))):
        if kind not in kinds:
            continue
        parts = [fn(d).withColumn("stage", F.lit(name)) for name, d in stages.items()]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        out[kind] = u
    return out

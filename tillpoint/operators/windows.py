"""Order-dependent windows (W2–W6): sliding sequences, lags, differences, ranks.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
partition. For a long series the rows are cut into blocks of consecutive
positions instead; each block gets a copy of the last ``L`` rows of the
block before it (a halo), so every row sees its ``L`` predecessors inside
its own block. Blocks are processed in parallel; only the halo is
duplicated (L / block_size of the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.operators.rowindex import with_row_index

DEFAULT_BLOCK = 100_000


def _blocked(df: DataFrame, pos_col: str, halo: int, block: int) -> DataFrame:
    """Rows tagged with ``_blk`` and ``_own`` (False for halo copies)."""
    if halo >= block:
        raise ValueError("block size must exceed the halo")
    blk = F.floor(F.col(pos_col) / F.lit(block)).cast("long")
    own = df.withColumn("_blk", blk).withColumn("_own", F.lit(True))
    tail = (df.where((F.col(pos_col) % F.lit(block)) >= F.lit(block - halo))
              .withColumn("_blk", blk + 1).withColumn("_own", F.lit(False)))
    return own.unionByName(tail)


def add_position(df: DataFrame, order_col: str, keys: list[str], pos_col: str = "_pos") -> DataFrame:
    """Dense 0-based position per series, by the distributed row index: no window gathers a series."""
    ranked = with_row_index(df, [*keys, order_col], col="_ix")
    if not keys:
        return ranked.withColumnRenamed("_ix", pos_col).withColumn(pos_col, F.col(pos_col).cast("int"))
    first = ranked.groupBy(*keys).agg(F.min("_ix").alias("_ix0"))
    return ranked.join(first, keys).withColumn(pos_col, (F.col("_ix") - F.col("_ix0")).cast("int")).drop("_ix", "_ix0")


def sliding_sequences(df: DataFrame, value_col: str, length: int, pos_col: str,
                      keys: list[str] | None = None, block: int = DEFAULT_BLOCK,
                      seq_col: str = "sequence", target_col: str = "target") -> DataFrame:
    """For row i ≥ L, ``sequence`` = values of rows i−L … i−1, ``target`` = value of row i.

    The output keeps every other column of the target row (its date, keys).
    n rows give n − L outputs per series.
    """
    keys = list(keys or [])
    b = _blocked(df, pos_col, length, block)
    w = (Window.partitionBy(*keys, "_blk").orderBy(pos_col)
         .rowsBetween(-length, -1))
    out = (b.withColumn(seq_col, F.collect_list(F.col(value_col).cast("double")).over(w))
            .where(F.col("_own") & (F.size(seq_col) == length)))
    return out.withColumn(target_col, F.col(value_col).cast("double")).drop("_blk", "_own")


def lag_columns(df: DataFrame, value_col: str, lags: list[int], pos_col: str,
                keys: list[str] | None = None, block: int = DEFAULT_BLOCK,
                diff: bool = True, prefix: str = "lag") -> DataFrame:
    """``lag_i`` = value i rows earlier (NULL before the start) and the first
    difference ``diff_1`` = value − lag_1, computed block-wise with a halo."""
    keys = list(keys or [])
    halo = max(lags) if lags else 1
    b = _blocked(df, pos_col, halo, block)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos_col)
    cols: dict[str, Column] = {f"{prefix}_{i}": F.lag(value_col, i).over(w) for i in lags}
    out = b.withColumns(cols)
    if diff:
        out = out.withColumn("diff_1", F.col(value_col) - F.lag(value_col, 1).over(w))
    return out.where("_own").drop("_blk", "_own")


def group_min(c: str, keys: list[str]) -> Column:
    """Minimum over the group, attached to each row."""
    return F.min(c).over(Window.partitionBy(*keys))

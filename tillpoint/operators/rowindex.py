"""Row position (W1) and fixed-size batches.

pandas keeps an implicit row order; Parquet has none. ``with_row_index``
derives a dense 0-based position from explicit order keys without a global
single-partition window:

1. range-partition the rows on the keys and sort inside each partition
   (one shuffle, balanced by sampling, so no hot partition when keys are
   unique);
2. ``monotonically_increasing_id`` then encodes (partition, local position);
3. one row per partition is counted, and the running partition offsets are
   turned into an array literal by partition number (its size is the partition
   count, a config value, never the data size);
4. position = offsets[partition] + local position — one array access a row.

The indexed frame is materialised (persist or checkpoint) before it is
counted, so a recomputed partition cannot renumber rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index in the upper 31 bits


def _key_columns(keys) -> list[Column]:
    return [k if isinstance(k, Column) else F.col(k) for k in keys]


def with_row_index(df: DataFrame, order_keys, col: str = "row_idx",
                   num_partitions: int | None = None,
                   materialize: str = "persist", keep: list[str] | None = None) -> DataFrame:
    """Add ``col`` = 0-based position of each row in ``order_keys`` order.

    ``order_keys`` must be unique per row for the index to be deterministic.
    ``keep`` (default: all) names the columns that are exchanged beside the keys and kept beside ``col``.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _key_columns(order_keys)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    if keep is not None:
        ranged = ranged.select(*keep)
    ranged = ranged.withColumn("_tp_mid", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged, materialize)

    part = F.shiftright(F.col("_tp_mid"), _LOCAL_BITS)
    local = F.col("_tp_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = sorted((r[0], r[1]) for r in
                    ranged.groupBy(part.alias("p")).count().collect())
    if not counts:
        return ranged.withColumn(col, local).drop("_tp_mid")
    rows = dict(counts)
    offsets = F.lit(list(accumulate((rows.get(p, 0) for p in range(max(rows))), initial=0))).cast("array<bigint>")
    return (ranged.withColumn(col, F.get(offsets, part.cast("int")) + local)
                  .drop("_tp_mid"))


def with_batches(df: DataFrame, batch_size: int, index_col: str = "row_idx",
                 batch_col: str = "batch_number") -> DataFrame:
    """Batch number from 1, ``batch_size`` consecutive rows per batch."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return df.withColumn(batch_col,
                         (F.floor(F.col(index_col) / F.lit(batch_size)) + 1).cast("int"))


def process_batches(df: DataFrame, order_keys, batch_size: int, func, schema,
                    batch_col: str = "batch_number") -> DataFrame:
    """S3 with a user callback: ``func(pandas_chunk, batch_number) -> frame or None``.

    Each batch (at most ``batch_size`` rows, a bounded group) goes to one
    ``applyInPandas`` call; empty or ``None`` results are skipped, and the
    union of all results is the returned DataFrame (U1).
    """
    import pandas as pd

    indexed = with_batches(with_row_index(df, order_keys), batch_size, batch_col=batch_col)
    out_cols = [f.name for f in schema.fields] if hasattr(schema, "fields") else None

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("row_idx").reset_index(drop=True)
        number = int(chunk[batch_col].iloc[0])
        res = func(chunk.drop(columns=["row_idx"]), number)
        if res is None or len(res) == 0:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in (out_cols or [])})
        return res[out_cols] if out_cols else res

    return indexed.groupBy(batch_col).applyInPandas(run, schema)

"""Batched DBSCAN jobs (G6, G7) and the cluster report.

The chunked reader of the original becomes a ``batch_number`` column
(S3); every per-batch step (minimum date, scaler fit, DBSCAN) is keyed by
it, so all batches run in the same Spark jobs, in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.cluster.dbscan import GROUP_ROWS, dbscan
from tillpoint.functions.dates import whole_days_between
from tillpoint.operators import aggregates as agg
from tillpoint.operators.cleaning import drop_missing
from tillpoint.operators.rowindex import with_batches, with_row_index
from tillpoint.operators.scale import scaled_value, with_parameters
from tillpoint.session import cut_lineage, discard

# The batched jobs' parameters.
BATCH_SIZE = 50_000
EPS = 0.5
MIN_SAMPLES = 5
TYPE1_FEATURES = ["Quantity", "UnitPrice", "CustomerID", "DaysSinceFirstPurchase"]
TYPE2_FEATURES = ["Quantity", "UnitPrice", "CustomerID"]


def batched(df: DataFrame, order_keys, batch_size: int = BATCH_SIZE, keep: list[str] | None = None) -> DataFrame:
    """Rows numbered in a stored table, and their batches."""
    return with_batches(with_row_index(df, order_keys, keep=keep, materialize="table"), batch_size)


def _labelled(b: DataFrame, numbered: DataFrame, features: list[str], params: list[str], eps: float, min_samples: int,
              most_rows: int | None) -> DataFrame:
    out = dbscan(b, [scaled_value(c) for c in features], eps, min_samples, keys=["batch_number"], drop=params, most_rows=most_rows)
    if most_rows is not None and most_rows <= GROUP_ROWS:  # the labelled rows are stored and read nothing else
        discard(numbered)
    return out


def dbscan_type1(df: DataFrame, order_keys, batch_size: int = BATCH_SIZE,
                 eps: float = EPS, min_samples: int = MIN_SAMPLES, scaler: str = "minmax",
                 owned: bool = False, whole_batches: bool = False) -> DataFrame:
    """Per batch — days since the batch's first (parsable) timestamp, the
    four features, rows with a gap dropped, scaling (min-max, or another kind of
    ``scale``), DBSCAN.
    Output: the four unscaled features, ``Cluster``, ``batch_number``, ``row_idx``.
    ``owned``: ``df`` is a stored table that nothing else reads; it goes once its rows are numbered.
    ``whole_batches``: a batch of at most ``GROUP_ROWS`` rows is labelled by one task."""
    numbered = b = batched(df, order_keys, batch_size, ["InvoiceDate", *TYPE1_FEATURES[:3]])
    if owned:
        discard(df)
    # one row a batch, measured, instead of a window: the rows stay where they are
    first = cut_lineage(b.groupBy("batch_number").agg(F.min("InvoiceDate").alias("_first")), "persist")
    b = b.join(first, "batch_number").withColumn("DaysSinceFirstPurchase", whole_days_between(F.col("_first"), F.col("InvoiceDate")))
    b = drop_missing(b, TYPE1_FEATURES).select(
        "row_idx", "batch_number", *[F.col(c).cast("double").alias(c) for c in TYPE1_FEATURES])
    b, params = with_parameters(b, TYPE1_FEATURES, scaler, ["batch_number"])
    return _labelled(b, numbered, TYPE1_FEATURES, params, eps, min_samples, batch_size if whole_batches else None)


def dbscan_type2(df: DataFrame, order_keys, batch_size: int = BATCH_SIZE,
                 eps: float = EPS, min_samples: int = MIN_SAMPLES, scaler: str = "standard",
                 keep: list[str] | None = None, owned: bool = False, whole_batches: bool = False) -> DataFrame:
    """Per batch — rows missing Quantity/UnitPrice/CustomerID dropped,
    standardisation (or another ``scaler``), DBSCAN; every input column kept (or the features and those of
    ``keep``), plus ``Cluster`` and ``BatchNumber``. ``owned`` and ``whole_batches`` as in ``dbscan_type1``."""
    if keep is not None:
        keep = TYPE2_FEATURES + [c for c in keep if c not in TYPE2_FEATURES]
    numbered = batched(df, order_keys, batch_size, keep)
    if owned:
        discard(df)
    b, params = with_parameters(drop_missing(numbered, TYPE2_FEATURES), TYPE2_FEATURES, scaler, ["batch_number"])
    out = _labelled(b, numbered, TYPE2_FEATURES, params, eps, min_samples, batch_size if whole_batches else None)
    return out.withColumn("BatchNumber", F.col("batch_number"))


def cluster_report(results: DataFrame, merge_batches: bool = False) -> dict[str, DataFrame]:
    """A10/A11 counts, A8 summary without noise, A9 country distribution.

    Labels restart in every batch, so by default everything is keyed by
    (BatchNumber, Cluster) (B9); ``merge_batches=True`` groups by label
    alone as the original does.
    """
    keys = [] if merge_batches else ["BatchNumber"]
    rep = {"counts": agg.cluster_counts(results, "Cluster", keys),
           "summary": agg.cluster_summary(results, "Cluster", keys)}
    if "Country" in results.columns:
        rep["country"] = agg.country_cluster_counts(results, "Cluster", keys)
        rep["country_filled"] = agg.country_cluster_counts(results, "Cluster", keys, filled=True)
    return rep

"""Categorical encoders (T5 label codes, T6 one-hot, T9 feature assembly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.rowindex import with_row_index


def label_codes(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """T5: codes 0…m−1 by sorted distinct value (``LabelEncoder``).

    The distinct values are indexed with the distributed row index (no
    single-partition window) and joined back; Catalyst/AQE choose a
    broadcast only when the code table is measured small.
    """
    out_col = out_col or f"{col}_encoded"
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = with_row_index(distinct, [col], col="_code").select(
        col, F.col("_code").cast("int").alias(out_col))
    return df.join(codes, col, "left")


def categories(df: DataFrame, col: str) -> list:
    """Sorted distinct values. They become columns of ``one_hot``, hence schema; ``one_hot_vector`` needs no list."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def one_hot(df: DataFrame, col: str, drop_first: bool = True,
            values: list | None = None, prefix: str | None = None) -> DataFrame:
    """``pd.get_dummies(drop_first=True)`` — one 0/1 column per category
    except the first in sorted order; the source column is removed."""
    prefix = prefix or col
    vals = values if values is not None else categories(df, col)
    keep = vals[1:] if drop_first else vals
    dummies = {f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in keep}
    return df.withColumns(dummies).drop(col) if dummies else df.drop(col)


def one_hot_vector(df: DataFrame, col: str, out_col: str | None = None, drop_first: bool = True) -> DataFrame:
    """T6 for any number of categories: one sparse vector column, without the first category in sorted order
    (the last of the descending index). Null rows give the zero vector."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    out_col = out_col or f"{col}_vector"
    indexed = StringIndexer(inputCol=col, outputCol="_index", stringOrderType="alphabetDesc",
                            handleInvalid="skip").fit(df)
    known, missing = df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())
    hot = OneHotEncoder(inputCol="_index", outputCol=out_col, dropLast=drop_first).fit(indexed.transform(known))
    out = hot.transform(indexed.transform(known)).drop("_index")
    size = max(0, len(indexed.labels) - int(drop_first))
    zero = F.lit(None).cast("array<double>") if not size else F.array_repeat(F.lit(0.0), size)
    from pyspark.ml.functions import array_to_vector
    return out.unionByName(missing.withColumn(out_col, array_to_vector(zero)))


def assemble(df: DataFrame, cols: list[str], out_col: str = "features") -> DataFrame:
    """Vector column for MLlib (sparse where it pays)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol=out_col, handleInvalid="error").transform(df)


# Fixed values (the defaults): the columns that the original job drops, codes and scales.
def kmeans_design(df: DataFrame, categorical: str = "Country", coded: str = "StockCode",
                  drop=("InvoiceNo", "StockCode", "Description", "InvoiceDate", "CustomerID"),
                  numeric=("Quantity", "UnitPrice")) -> tuple[DataFrame, list[str]]:
    """The K-Means design — numeric columns, country dummies (first
    dropped, one sparse vector), stock-code label; returns the frame and the feature names."""
    enc = one_hot_vector(label_codes(df, coded, f"{coded}_encoded"), categorical, f"{categorical}_dummies")
    feats = list(numeric) + [f"{categorical}_dummies", f"{coded}_encoded"]
    return enc.drop(*[c for c in (*drop, categorical) if c in enc.columns]), feats

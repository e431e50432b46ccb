"""Written intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillpoint.session import scratch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for this run's table ``name``."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: its lineage
    is cut, and a lost executor costs no recomputation of what stands before it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

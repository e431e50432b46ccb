"""Structured Streaming form of the chunked reader (S3).

Invoice files arriving in a folder are read as a stream, a bounded number
of files per micro-batch; each micro-batch is one "batch" of the original
chunk loop and is handed to a DataFrame callback. Results are written to a
sink partitioned by batch number with dynamic partition overwrite, so a
replayed micro-batch (``foreachBatch`` is at-least-once) replaces its own
partition instead of duplicating it. ``availableNow`` processes what is
there and stops, which makes the job restartable from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_file_batches(spark: SparkSession, source_dir: str, schema: T.StructType,
                     func: Callable[[DataFrame, int], DataFrame | None], sink_dir: str,
                     checkpoint_dir: str, files_per_batch: int = 1,
                     fmt: str = "parquet") -> None:
    """Apply ``func(batch_df, batch_number)`` to every micro-batch of the files
    in ``source_dir``; non-empty results are written under ``sink_dir``."""
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", files_per_batch).load(source_dir))

    def handle(batch: DataFrame, epoch_id: int) -> None:
        number = int(epoch_id) + 1
        res = func(batch, number)
        if res is None:
            return
        (res.withColumn("batch_number", F.lit(number))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_number").parquet(sink_dir))

    q = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()

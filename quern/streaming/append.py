"""Buffered append as a stream: each micro-batch becomes a generation of the column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_generations(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of pairs; a batch that is retried overwrites its own folder, so each counts once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select("id", "value").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/gen={number}")

    return pairs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """(id, value, gen) of all batches so far."""
    return spark.read.parquet(path).select("id", "value", F.col("gen").cast("int").alias("gen"))

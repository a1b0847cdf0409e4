"""Counts that grow file by file, resumable after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accumulate_counts(spark: SparkSession, source: str, schema: str, keys: list[str], target: str, checkpoint: str, files_per_batch: int = 8) -> None:
    """Count rows by ``keys`` over the files of ``source`` that have not been seen yet.

    Each micro-batch writes its partial counts into a folder of its own number, replacing what a
    failed attempt may have left, so each file counts once; the checkpoint is the progress log.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulated(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("n").alias("n"))

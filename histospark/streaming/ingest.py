"""New image files as a stream: each micro-batch goes through a batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pixel_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of pixel tables (Parquet) that appear below ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def process(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``plan`` on each micro-batch and write its result below ``out``, one folder per batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        plan(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

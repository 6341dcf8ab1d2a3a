"""Stateless pixel operators over streams of pixel tables.

Column operators and matching against fixed references need no state, so the
same functions run on ``readStream``; each micro-batch is a lazy plan of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def pixel_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to Parquet files, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless steps in order."""
    for step in steps:
        df = df.transform(step)
    return df

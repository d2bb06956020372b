"""Samples that arrive as Parquet files, selected and cut by time on the way.

An extension: the batch operators that look at one row (selection, time ranges) are the
same on a stream. Laps, resampling and merging need a whole log and run in batch on
what was ingested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import select_channels, time_range


def follow(spark: SparkSession, path: str, schema: T.StructType, channels: list[str], fixed: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """A stream of the samples in a folder: some channels, half-open time range."""
    rows = spark.readStream.schema(schema).parquet(path)
    if start is not None or end is not None:
        rows = time_range(rows, -(1 << 63) if start is None else start, (1 << 63) - 1 if end is None else end)
    return select_channels(rows, channels, fixed)


def write_bounded(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, each file once, and stop."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)

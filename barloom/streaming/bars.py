"""Structured Streaming forms of the tick operators: bars and first ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import instant


def tick_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, delay: str = "2 minutes", ts: str = "ts") -> DataFrame:
    """Event time with a watermark, which needs an instant: UTC wall time is converted, an instant is kept."""
    when = F.col(ts) if dict(df.dtypes)[ts] == "timestamp" else instant(F.col(ts))
    return df.withColumn(ts, when).withWatermark(ts, delay)


def stream_bars(ticks: DataFrame, freq: str = "1 minute", delay: str = "2 minutes", keys: Sequence[str] = ("symbol",), slide: str | None = None) -> DataFrame:
    """The aggregates of ``resample``, one row per closed bar; ``slide`` gives overlapping bars."""
    w = F.window("ts", freq, slide) if slide else F.window("ts", freq)
    out = event_time(ticks, delay).groupBy(*keys, w.alias("_bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
    )
    return out.select(*keys, F.col("_bar.start").alias("ts"), "price", "high", "low", "volume")


def stream_first(ticks: DataFrame, delay: str = "2 minutes", keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """First arrival per key; repeats inside the watermark are dropped."""
    return event_time(ticks, delay).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, folder: str, mode: str = "append"):
    """Process what is there, write it below ``folder``, stop; returns the finished query."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

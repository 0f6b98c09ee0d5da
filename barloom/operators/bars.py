"""Ticks to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(df: DataFrame, freq: str = "1 minute", keys: Sequence[str] = ("symbol",), anchor: str = "0 minutes") -> DataFrame:
    """Last price, highest high, lowest low and total volume per bar; bars without ticks do not appear.

    Everything is a partial aggregate, so a hot symbol shrinks to its bars before the shuffle.
    """
    out = df.groupBy(*keys, F.window("ts", freq, startTime=anchor).alias("_bar")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
    )
    out = out.where(F.col("price").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull())
    return out.select(*keys, F.col("_bar.start").alias("ts"), "price", "high", "low", "volume")


def trading_days(df: DataFrame, day: Column, start: str | None = None, end: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct days with data inside a range."""
    out = df.select(*keys, day.alias("session_date"))
    if start:
        out = out.where(F.col("session_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("session_date") <= F.lit(end).cast("date"))
    return out.distinct()

"""Measured stage times of a streaming query against the length of a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bar lengths in milliseconds.
WINDOWS = {"1m": 60_000.0, "5m": 300_000.0}


def stage_times(spark: SparkSession, query) -> DataFrame:
    """(batch, rows, stage, ms) from the query's recent progress (a short driver-side list)."""
    rows = [
        (int(p["batchId"]), int(p["numInputRows"]), stage, float(ms)) for p in query.recentProgress for stage, ms in p["durationMs"].items()
    ]
    return spark.createDataFrame(rows, "batch long, rows long, stage string, ms double")


def latency_budget(stages: DataFrame, windows: dict[str, float] = WINDOWS) -> DataFrame:
    """Sum of the fastest and slowest stage times, as a share of each window and as headroom.

    ``stages`` has (stage, ms); the total of a batch is not counted as a stage.
    """
    per = stages.where("stage <> 'triggerExecution'").groupBy("stage").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    total = per.agg(F.sum("low").alias("pipeline_ms_low"), F.sum("high").alias("pipeline_ms_high"))
    table = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(v).alias("budget_ms")) for k, v in windows.items()])
    out = total.select("*", F.inline(table))
    for end in ("low", "high"):
        ms = F.col(f"pipeline_ms_{end}")
        out = out.withColumns({f"budget_used_pct_{end}": ms / F.col("budget_ms") * 100.0, f"headroom_ms_{end}": F.col("budget_ms") - ms})
    return out

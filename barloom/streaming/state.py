"""Batch steps over a stream: the last rows of each key are kept between micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.plans.steps import SERIES, TICK_ORDER, Step, on_series

# -- buffers ---------------------------------------------------------------------------------------


def with_history(spark: SparkSession, steps: Sequence[Step], folder: str, keys: Sequence[str] = SERIES, order: Sequence[str] = TICK_ORDER) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that runs batch steps on a stream.

    The last rows each key needs for the steps' reach are kept between micro-batches, so a batch is the stored
    tail plus the new rows; the steps split a hot key like in batch work.  Outputs and tails are written per
    batch id, so a repeated batch replaces its own output. Recurrences reach back to the first row and are refused;
    ``ordered.stream_recurrences`` keeps their state. Rows are taken in the order of their micro-batches: a feed whose rows come
    late needs ``ordered.stream_scores``.
    """
    if any(s.unbounded for s in steps):
        raise ValueError("recurrences have no bounded history; use ordered.stream_recurrences")
    back = max(s.back for s in steps)
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        if batch_id > 0:
            tail = spark.read.parquet(f"{folder}/tail/batch={batch_id - 1}").withColumn("_new", F.lit(False))
            rows = tail.unionByName(rows.select(*tail.columns))
        out = on_series(rows, steps, keys, order).where("_new").drop("_new")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        kept = rows.drop("_new").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= back).drop("_n")
        kept.write.mode("overwrite").parquet(f"{folder}/tail/batch={batch_id}")

    return write


def stream_buffer(x: str, n: int, name: str = "score", fn: Callable[[np.ndarray], float] | None = None) -> Step:
    """Score of the last ``n`` values, only once the buffer is full: their mean, or the caller's function."""
    if fn is not None:
        from barloom.functions.custom import rolling_apply

        return rolling_apply(x, n, fn, name)
    return Step(lambda tl: tl.add({name: F.when(F.count(x).over(tl.over(-(n - 1), 0)) == n, F.avg(x).over(tl.over(-(n - 1), 0)))}), back=n)


def run_steps(stream: DataFrame, steps: Sequence[Step], folder: str, **kw):
    """Drain a stream through batch steps; rows arrive below ``folder/rows``."""
    query = (
        stream.writeStream.foreachBatch(with_history(stream.sparkSession, list(steps), folder, **kw))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

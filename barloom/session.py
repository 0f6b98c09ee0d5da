"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest group (rows) that one window task may own before it is split into chunks.
GROUP_ROWS_CONF = "barloom.maxGroupRows"
GROUP_ROWS_DEFAULT = 500_000

#: Largest group (rows) that one Python function may hold; its rows are objects there, many times their size in Spark.
PYTHON_ROWS = 65_536

#: Largest side (rows) that may be hinted for broadcast.
BROADCAST_ROWS = 200_000


def build_session(app: str = "barloom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def python_rows(spark: SparkSession) -> int:
    return min(max_group_rows(spark), PYTHON_ROWS)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch folder is chosen only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            wanted = tempfile.mkdtemp(prefix="barloom-checkpoint-")
        sc.setCheckpointDir(wanted)
        current = sc.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that lost executors cost a re-read and not a wrong row."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Pin a derived side and hint a broadcast only when it is counted to be below ``limit`` rows.

    Pinning keeps the count from running the side's plan a second time; a larger side is left to the planner. A pinned table
    keeps the size that was estimated for its plan, and a join's estimate is the product of its sides: a loop that joins a
    table with what came of that join would square the estimate in each pass, to numbers of millions of digits. The limit,
    which cuts no row, bounds the estimate.
    """
    pinned = durable(df)
    return F.broadcast(pinned.limit(limit)) if pinned.limit(limit + 1).count() <= limit else pinned

"""Sinks: day-partitioned tables, fold outputs, prediction files, completeness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import SCHEMA_VERSION

ROW_GROUP_ROWS = 50_000


def stamp(df: DataFrame, version: str = SCHEMA_VERSION, stage: str = "raw") -> DataFrame:
    """Carry the schema version in the column metadata, which Parquet keeps."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"schema_version": version, "stage": stage}) for c in df.columns])


def write_days(df: DataFrame, path: str, stage: str = "raw", by: Sequence[str] = ("session_date",), spread: int = 1) -> None:
    """Replace the days in ``df`` of a day-partitioned Parquet table.

    Rows go to their day before the write, so a day has few files; ``spread`` splits each day over that
    many tasks when one day is large.
    """
    salted = df if spread <= 1 else df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(spread)))
    placed = salted.repartition(*by, *(["_salt"] if spread > 1 else [])).drop("_salt")
    (
        stamp(placed, stage=stage)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*by)
        .parquet(path)
    )


def write_folds(df: DataFrame, path: str) -> None:
    """Fold outputs as one table partitioned by fold, family and role."""
    write_days(df, path, stage="normalized", by=("fold", "family", "role"))


def replace_dimension(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def convert_csv(spark: SparkSession, pattern: str, numbers: Sequence[str], path: str) -> None:
    """CSV files by glob to one partitioned table, the symbol taken from the file name."""
    raw = spark.read.option("header", True).csv(pattern)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_1min)?\.csv[^/]*(?:/[^/]*)?$", 1)
    from barloom.functions.scalars import number, read_timestamp

    out = raw.select(
        F.lower(name).alias("symbol"), read_timestamp(F.col("timestamp")).alias("ts"), *[number(F.col(n)).alias(n) for n in numbers]
    )
    out = out.where("ts IS NOT NULL").withColumn("session_date", F.to_date("ts"))
    write_days(out, path)


def write_predictions(df: DataFrame, summary: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/predictions")
    summary.write.mode("overwrite").json(f"{folder}/metrics")


def pending_days(wanted: DataFrame, written: DataFrame) -> DataFrame:
    """Wanted days without an output yet."""
    return wanted.select("session_date").distinct().join(written.select("session_date").distinct(), "session_date", "left_anti")


def missing_outputs(expected: DataFrame, actual: DataFrame, by: Sequence[str] = ("fold", "family", "role")) -> DataFrame:
    return expected.select(*by).distinct().join(actual.select(*by).distinct(), list(by), "left_anti")

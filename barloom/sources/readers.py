"""File sources: bars and ticks from CSV and Parquet, dated stages, dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import number, read_timestamp
from barloom.operators.clean import first_per, rename_aliases, valid_ticks
from barloom.schema import PRICE_PRIORITY, TICK_COLUMNS


def read_bars_csv(spark: SparkSession, path: str | list[str], numbers: Sequence[str], others: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """CSV bars with a ``timestamp`` column in mixed formats; unreadable stamps are dropped, bad numbers are null."""
    names = ["timestamp", *others, *numbers]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    out = raw.select(read_timestamp(F.col("timestamp"), zone=zone).alias("ts"), *others, *[number(F.col(n)).alias(n) for n in numbers])
    return out.where("ts IS NOT NULL")


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _as_ticks(df: DataFrame, dedupe: bool) -> DataFrame:
    df = require_columns(rename_aliases(df), TICK_COLUMNS)
    kind = dict(df.dtypes)["timestamp"]
    ts = read_timestamp(F.col("timestamp")) if kind == "string" else F.col("timestamp").cast("timestamp_ntz")
    df = df.withColumns({c: number(F.col(c)) for c in TICK_COLUMNS[1:]}).withColumn("ts", ts).drop("timestamp")
    df = valid_ticks(df)
    if not dedupe:
        return df
    keys = ["symbol", "ts"] if "symbol" in df.columns else ["ts"]
    order = ["seq"] if "seq" in df.columns else list(TICK_COLUMNS[1:])
    return first_per(df, keys, order)


def read_ticks(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """One tick file, CSV or Parquet by its suffix, validated and with the first tick per timestamp."""
    plain = path.rstrip("/").lower()
    if plain.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif plain.endswith((".csv", ".csv.gz")):
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown suffix: {path}")
    return _as_ticks(df, dedupe)


def _tree(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .option("mergeSchema", True)
    )
    return reader.parquet(folder)


def read_tick_tree(spark: SparkSession, folder: str, newest: int | None = None, dedupe: bool = True, glob: str = "*.parquet") -> DataFrame:
    """Parquet files anywhere below a folder, optionally the newest by name; unreadable files are skipped, ``silent_files`` names
    them. The newest are chosen from the listing, so other files are not opened."""
    if newest is None:
        return _as_ticks(_tree(spark, folder, glob), dedupe)
    names = _listing(spark, folder, glob).orderBy(F.col("path").desc()).limit(newest)
    paths = [r["path"] for r in names.collect()]  # as many as asked for
    df = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*paths)
    return _as_ticks(df, dedupe)


def _listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``path, length`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return files.load(folder).select("path", "length")


def silent_files(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """``path, length`` of the files that gave no row: unreadable ones, and files without rows."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    seen = _tree(spark, folder, glob).select(plain(F.col("_metadata.file_path")).alias("_seen")).distinct()
    files = _listing(spark, folder, glob)
    return files.join(seen, plain(F.col("path")) == F.col("_seen"), "left_anti")


def price_column(columns: Sequence[str], wanted: str | None = None) -> str:
    """Price column of a constituent table: the wanted one, else the first known name."""
    for name in ([wanted] if wanted else []) + list(PRICE_PRIORITY):
        if name in columns:
            return name
    raise ValueError("no price column")


def constituents(df: DataFrame, price: str | None = None) -> DataFrame:
    """Long constituent table (timestamp, ticker, price-like) with one price column."""
    require_columns(df, ["timestamp", "ticker"])
    px = price_column(df.columns, price)
    out = df.select(F.col("timestamp").alias("ts"), F.col("ticker").alias("symbol"), number(F.col(px)).alias("price"))
    return out.where("ts IS NOT NULL AND symbol IS NOT NULL")


def stage_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Dated rows inside a range; rows without a date are always kept."""
    day = F.col("session_date")
    return df.where(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def feature_range(df: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the listed days, and the listed days without rows."""
    listed = days.select("session_date").distinct()
    missing = listed.join(df.select("session_date").distinct(), "session_date", "left_anti")
    return df.join(listed, "session_date", "left_semi"), missing


def dimension(spark: SparkSession, path: str, schema: T.StructType, default: tuple | None = None) -> DataFrame:
    """CSV dimension with a fixed schema; an absent file gives an empty table or its default row."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    df = spark.read.schema(schema).option("header", True).csv(path) if exists else spark.createDataFrame([], schema)
    return with_default(df, schema, default)


def with_default(df: DataFrame, schema: T.StructType, default: tuple | None) -> DataFrame:
    """The table, or its default row when it is empty."""
    if default is None or df.limit(1).count():
        return df
    row = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(default, schema.fields)]
    return df.sparkSession.range(1).select(*row)

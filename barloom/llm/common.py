"""Shared pieces of the text operators: written stages, stable row keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def columns_of(docs: DataFrame, names=("doc_id", "text", "lang", "source", "n_chars")) -> list[str]:
    return [c for c in names if c in docs.columns]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``node, root`` with ``root`` the smallest node reachable.

    Alternating large and small star steps: each round links every node to the least node it sees, so a chain of n
    links needs about log n rounds. A round is two shuffles of the links; nothing is collected but a checksum.
    """
    spark = edges.sparkSession
    links = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )

    def checksum(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = checksum(links)
    if seen[0] == 0:
        return spark.createDataFrame([], "node bigint, root bigint")
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = staged(small.distinct(), "links")
        now = checksum(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())

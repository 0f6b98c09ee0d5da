"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet in the shared checkpoint folder and reads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, line_chunks, mixing, simhash_tiles
from barloom.llm.common import read_table, staged

#: A text whose best language has a smaller share of the score than this is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no language: null, without a letter, or with a score below ``LEAST_SCORE``. ``lang`` stays as given."""
    judged = langid.identify(docs, langid.fit(docs))
    return judged.where((F.col("lang_pred") != langid.UNDEFINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines out of ``text``; ``n_chars`` follows where the text was cut."""
    cut = line_chunks.dedup(docs)
    n_chars = F.when(F.col("removed_chunks") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the least doc_id, rows without one last, repeated rows once."""
    return simhash_tiles.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a positive rate, with ``tokens``, the domain posteriors and ``rate``."""
    rates = mixing.mix(docs, read_table(spark, sf_dir, "labels")).where("rate > 0")
    rates = rates.withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    added = ["tokens", "p_good", "p_poor", "p_toxic", "rate"]
    same = docs["doc_id"].eqNullSafe(rates["_doc"]) & (F.xxhash64(docs["text"]) == rates["_row"])
    return docs.join(rates, same).select(*[docs[c] for c in docs.columns if c not in added], *[rates[c] for c in added])


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no SimHash over XXH64, no content-defined chunks and no trained models; tests compare with brute force.
ORACLE_SQL = None

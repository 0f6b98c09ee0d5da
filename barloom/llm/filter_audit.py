"""Filter interaction audit over sorted posting lists.

Which documents does a filter remove, given the filters that ran before it? Every part (source) is cut into id ranges. In
a range each filter has the sorted list of the ids that fail it; unions of lists and differences of lists are made by
galloping k-way merges, and only their sizes leave the range. A size depends on the set of filters that ran before and not
on their order, so 32 unions and 80 differences per range serve all 120 orders; sums of sizes over ranges are exact.

Ranges come from a range partitioning by (part, id), which splits a part of any size, and hold ``range_rows`` documents at
most, so a task keeps one range. Texts are read once and are never shuffled: what moves is one narrow row per document.
"""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged

FILTERS = "ABCDE"
RANGE_ROWS = 65_536
BLOCK = 1024
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIZES = "part string, before int, filter int, n bigint, removed bigint, reached bigint, good_lost bigint, toxic_lost bigint"


def gallop(ids: np.ndarray, wanted: int, at: int) -> int:
    """First place from ``at`` on in sorted ``ids`` that is not below ``wanted``: doubling steps, then a binary search."""
    step, end = 1, len(ids)
    low = at
    while at < end and ids[at] < wanted:
        low, at, step = at + 1, at + step, step * 2
    return low + int(np.searchsorted(ids[low : min(at, end)], wanted))


def union(lists: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """Sorted ids in any of the sorted lists.

    The list with the least head gallops to the next head and gives that run whole; where runs are short, an id range that
    takes ``block`` ids of a list at most is merged at once.
    """
    lists = [x for x in lists if len(x)]
    runs = []
    while len(lists) > 1:
        lists.sort(key=lambda x: x[0])
        end = gallop(lists[0], lists[1][0], 0)
        if end >= block:
            runs.append(lists[0][:end])
            lists[0] = lists[0][end:]
        else:
            bound = min(x[min(block, len(x)) - 1] for x in lists)
            ends = [gallop(x, bound + 1, 0) for x in lists]
            merged = np.sort(np.concatenate([x[:e] for x, e in zip(lists, ends)]), kind="stable")
            runs.append(merged[np.append(True, merged[1:] != merged[:-1])])
            lists = [x[e:] for x, e in zip(lists, ends)]
        lists = [x for x in lists if len(x)]
    return np.concatenate([*runs, *lists]) if runs or lists else np.empty(0, np.int64)


def difference(ids: np.ndarray, gone: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Sorted ``ids`` that are not in sorted ``gone``: long runs between two gone ids whole, id ranges of short runs at once."""
    runs = []
    while len(ids) and len(gone):
        end = gallop(ids, gone[0], 0)
        if end >= block:
            runs.append(ids[:end])
            ids = ids[end:]
            continue
        bound = min(x[min(block, len(x)) - 1] for x in (ids, gone))
        end, last = gallop(ids, bound + 1, 0), gallop(gone, bound + 1, 0)
        at = np.searchsorted(gone[:last], ids[:end])
        runs.append(ids[:end][gone[np.minimum(at, len(gone) - 1)] != ids[:end]])
        ids, gone = ids[end:], gone[last:]
    return np.concatenate([*runs, ids]) if runs else ids


def range_sizes(n: int, failing: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """Of one range of ``n`` documents: ``before, filter, n, removed, reached, good_lost, toxic_lost`` for every set of filters
    that ran before (a bit mask) and every filter that did not. ``reached`` is the size of the union with the filter."""
    every = range(len(failing))
    unions = {0: np.empty(0, np.int64)}
    out = []
    for before in range(1 << len(failing)):
        if before & (before - 1):
            unions[before] = union([failing[k] for k in every if before >> k & 1])
        elif before:
            unions[before] = failing[before.bit_length() - 1]
        for k in every:
            if not before >> k & 1:
                left = difference(failing[k], unions[before])
                lost = [len(left) - len(difference(left, marked)) for marked in (good, toxic)]
                out.append((before, k, n, len(left), len(unions[before]) + len(left), *lost))
    return out


def _sizes(range_rows: int):
    def cut(block: pd.DataFrame):
        for part, rows in block.groupby("part", sort=False):
            for at in range(0, len(rows), range_rows):
                some = rows.iloc[at : at + range_rows]
                marks = [np.flatnonzero(some[c].to_numpy(bool)) for c in [*(f"f_{x}" for x in FILTERS), "good", "toxic"]]
                sizes = range_sizes(len(some), marks[:-2], *marks[-2:])
                yield pd.DataFrame([(part, *x) for x in sizes], columns=[x.split()[0] for x in SIZES.split(", ")])

    def run(batches):
        held, rows = [], 0
        for b in batches:  # rows come ordered by part and id; a place in a range stands for its id
            while len(b):
                take = b.iloc[: range_rows - rows]
                b = b.iloc[len(take) :]
                held.append(take)
                rows += len(take)
                if rows == range_rows:
                    yield from cut(pd.concat(held))
                    held, rows = [], 0
        if held:
            yield from cut(pd.concat(held))

    return run


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, f_A .. f_E`` for every row of ``docs``, by the five filters of the audit.

    A null text is the empty one, a null source the part ''. E compares whole texts (SHA-256 of their bytes) over the table: a row
    fails if a row with a smaller doc_id has the same text; a null doc_id is neither smaller nor larger than another.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select("doc_id", F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    base = base.withColumn("words", words)
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    narrow = base.select(
        "doc_id",
        "part",
        (F.size("words") < 200).alias("f_A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("f_B"),
        (100 * upper.cast("bigint") > 2 * F.length("text")).alias("f_C"),
        F.col("text").rlike(r"[#$%&*|]").alias("f_D"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
    )
    narrow = staged(narrow, "failures")
    least = narrow.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("_sha"), "least")
    # written apart, so that both sides of the join are plain exchanges and a hot text can be split
    least = staged(least, "copies")
    joined = narrow.join(least, narrow["sha"] == least["_sha"], "left")
    return joined.select("doc_id", "part", "f_A", "f_B", "f_C", "f_D", F.coalesce(F.expr("doc_id > least"), F.lit(False)).alias("f_E"))


def set_sizes(marked: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sums over ranges of :func:`range_sizes` by part. ``marked``: ``doc_id, part, f_A .. f_E, good, toxic``, one row per document."""
    laid = marked.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    sizes = laid.select("part", *[f"f_{x}" for x in FILTERS], "good", "toxic").mapInPandas(_sizes(range_rows), SIZES)
    names = [x.split()[0] for x in SIZES.split(", ")[3:]]
    return sizes.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in names])


def order_table(spark: SparkSession) -> DataFrame:
    """The 600 steps of the 120 orders: ``filter_order, step, before, filter``."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        rows += [(name, step + 1, sum(1 << k for k in order[:step]), k) for step, k in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(docs: DataFrame, labels: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, zeros included.

    Every row of ``docs`` counts as a document, repeated rows too. A document is good (toxic) if a row of ``labels`` with its doc_id
    says so; null and missing labels say nothing. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    says = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("is_toxic"))
    says = says.where("quality = 1 or is_toxic = 1").withColumnRenamed("doc_id", "_doc")
    marked = failures(docs)
    marked = marked.join(says, marked["doc_id"] == says["_doc"], "left")
    flags = [F.coalesce(F.expr(x), F.lit(False)).alias(c) for x, c in (("quality = 1", "good"), ("is_toxic = 1", "toxic"))]
    sizes = staged(set_sizes(marked.select("doc_id", "part", *[f"f_{x}" for x in FILTERS], *flags), range_rows), "set-sizes")
    most = len(FILTERS)
    orders = "element_at(array(%s), bit_count(before) + 1)" % ", ".join(str(factorial(s) * factorial(most - 1 - s)) for s in range(most))
    others = f"before = {(1 << most) - 1} - shiftleft(1, filter)"
    whole = sizes.groupBy(F.col("part").alias("_part"), F.col("filter").alias("_filter")).agg(
        F.sum(F.expr(f"removed * {orders}")).alias("shapley"),
        F.max(F.expr("if(before = 0, removed, null)")).alias("failing"),
        F.max(F.expr(f"if({others}, removed, null)")).alias("unique_fails"),
    )
    sizes = sizes.join(whole, (F.col("part") == F.col("_part")) & (F.col("filter") == F.col("_filter")))
    # 600 rows whatever the input
    steps = sizes.join(F.broadcast(order_table(spark)), ["before", "filter"])
    redundant = (F.col("failing") - F.col("removed")).alias("redundant")
    kept = (F.col("n") - F.col("reached")).alias("kept")
    return steps.select("part", "filter_order", "step", kept, "removed", redundant, "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), says AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM texts t LEFT JOIN says s ON t.doc_id = s.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT filter_order, step, ks[step] AS k, ks[1:step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, k, n, good, toxic, fails[k] AS failing,
         len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone,
         len(list_filter(fails, lambda f: f)) = 1 AS alone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, k,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failing AND alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM counted
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": _SQL}

"""Source divergence audit: smoothed term rates of every source against its peers and against its language.

Terms are counted once per text and summed by (lang, source, term); a language keeps the terms of at least ``min_docs`` of its
documents. Rates are integers ``1 + floor(10^9 (count + 5) / (N + 5 V))``, so every sum is exact.

Sums of ``|p - q|`` over all kept terms are taken by Gustavson's row accumulation. A block holds some kept terms of one
language with the sources that use them (the term-major index). Each source walks its own terms and scatters every peer
that the index names into one dense array over all peers; no (source, peer, term) row is ever made. A term that a source
lacks still has a rate, the source's baseline ``z``, so a term adds ``|p - q|`` where both have it, ``|p - z'|`` or ``|z - q|``
where one has it, and ``|z - z'|`` elsewhere. The row accumulation adds the difference from these baselines for shared terms;
the rest comes from sorted rates and their running sums. Blocks are cut by the hash of the term, and their arrays are summed,
so no task holds a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged
from barloom.session import small_side

#: Bytes of terms, A-Z as a-z; all others are a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A sum counts occurrences in its lower bits and documents above them.
SHIFT = 40
ONE_DOC = 1 << SHIFT
SCALE = 1_000_000_000
MIN_DOCS = 30
TOP = 50
BLOCK_POSTINGS = 1 << 14
#: Sums that one task makes at once; more sources are cut into slices.
SLICE = 1 << 22
HELD_TERMS = 1_000_000


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term, summed within a task already.

    A task holds ``held`` sums at most (and a text more); then it gives them out and starts anew, so a key may come more than
    once. Terms are cut out of the UTF-8 bytes: all bytes of other characters than ASCII belong to terms.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def give(sums: dict):
        for (lang, source), own in sums.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            whole = [pa.array([x]).take(pa.array(np.zeros(len(own), np.int8))) for x in (lang, source)]
            terms = pa.array(own.keys(), pa.binary()).cast(pa.string())
            columns = [*whole, terms, pa.array(both & (ONE_DOC - 1)), pa.array(both >> SHIFT)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        sums, n = defaultdict(dict), 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own = sums[lang, source]
                n -= len(own)
                get = own.get
                for term, k in Counter(text.encode().translate(TERM_BYTES).split()).items():
                    own[term] = get(term, 0) + k + ONE_DOC
                n += len(own)
                if n >= held:
                    yield from give(sums)
                    sums, n = defaultdict(dict), 0
        yield from give({k: own for k, own in sums.items() if own})

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _rate(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))``, null where there are no terms. Decimals, so nothing overflows."""
    top = (count.cast("decimal(18,0)") + 5) * F.lit(SCALE).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", top, (total + 5 * terms).cast("decimal(18,0)"))


def _accumulate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A block of a language for some of its sources: ``left`` its postings ``term, peer, p``, ``right`` all sources ``peer, zero,
    mine``. Gives the block's sums of the sources that are ``mine`` against all sources."""
    right = right.sort_values("peer")
    zero = right["zero"].to_numpy(np.int64)
    n, mine = len(zero), np.flatnonzero(right["mine"].to_numpy(bool))
    which, terms = pd.factorize(left["term"])
    order = np.lexsort((left["peer"].to_numpy(np.int64), which))
    term, peer, p = which[order], left["peer"].to_numpy(np.int64)[order], left["p"].to_numpy(np.int64)[order]
    start = np.searchsorted(term, np.arange(len(terms) + 1))  # the term-major index: term -> its postings
    by_peer = np.argsort(peer, kind="stable")
    first = np.searchsorted(peer[by_peer], np.arange(n + 1))
    rows = [by_peer[a:b] for a, b in zip(first, first[1:])]

    def beyond(own: int, others: np.ndarray) -> np.ndarray:
        """Of the terms of ``own``: rates to the baselines of ``others``, beyond the gap of the baselines themselves."""
        rates = np.sort(p[rows[own]])
        sums = np.concatenate([[0], np.cumsum(rates)])
        base = zero[others]
        low = np.searchsorted(rates, base)
        return base * low - sums[low] + (sums[-1] - sums[low]) - base * (len(rates) - low) - len(rates) * np.abs(zero[own] - base)

    to_mine = np.array([beyond(h, mine) for h in range(n)])
    out = []
    for k, g in enumerate(mine):
        sums = len(terms) * np.abs(zero[g] - zero) + beyond(g, np.arange(n)) + to_mine[:, k]
        for some in np.array_split(rows[g], len(rows[g]) * n // 1_000_000 + 1):  # scatters a million entries at most
            size = start[term[some] + 1] - start[term[some]]
            at = np.repeat(start[term[some]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            h, q, own = peer[at], p[at], np.repeat(p[some], size)
            np.add.at(sums, h, np.abs(own - q) - np.abs(own - zero[h]) - np.abs(q - zero[g]) + np.abs(zero[g] - zero[h]))
        out.append(sums)
    return pd.DataFrame({"lang": right["lang"].iloc[0], "peer": mine, "sums": out})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language with the sum of ``|p - q|`` over the kept terms (0 if there are none).
    Part ``term``: the ``top`` kept terms of a source whose rate lies above the language's, with the difference. Ranks go by value
    descending, then by the item's UTF-8 bytes. Null ``lang``, ``source`` and ``text`` are ''; every row counts as a document, repeated
    rows too; other columns are not read. A source without terms has baselines only. An empty table gives an empty result.
    """
    plain = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(plain).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = staged(counts, "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = staged(kept.select("lang", "term", "lang_n"), "kept-terms")
    postings = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "postings")

    # one row per (language, source) and one per language: tables of sums
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = plain.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = staged(sources.withColumn("peer", place), "sources")
    langs = sources.groupBy("lang").agg(F.count("*").alias("peers"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = langs.join(postings.groupBy("lang").agg(F.count("*").alias("postings")), "lang", "left")
    # a block has at least about as many postings as it has sums; a slice of sources has SLICE sums at most
    size = F.greatest(F.lit(block_postings), F.least(64 * F.lit(block_postings), F.expr("peers * peers div 4")))
    langs = langs.withColumn("blocks", F.coalesce(F.ceil(F.col("postings") / size), F.lit(1)).cast("int"))
    langs = small_side(langs.withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(SLICE) / F.col("peers")))))
    with_lang = staged(sources.join(langs, "lang"), "sources")
    zero = F.coalesce(_rate(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)).alias("zero")
    of_source = with_lang.select("lang", "source", "peer", "peers", "total", "terms", "lang_total", "blocks", "rows")
    numbered = postings.join(small_side(of_source), ["lang", "source"])
    numbered = numbered.withColumn("p", _rate(F.col("n"), F.col("total"), F.col("terms")))

    slices = F.explode(F.expr("sequence(0L, (peers - 1) div rows)")).alias("slice")
    block = F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block")
    index = numbered.select("lang", block, slices, "term", "peer", "p")
    peers = with_lang.select("lang", "peer", zero, "peers", "rows", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    peers = peers.select("lang", "block", slices, "peer", "zero", "rows").withColumn("mine", F.expr("peer div rows = slice"))
    keys = ["lang", "block", "slice"]
    sums = index.groupBy(*keys).cogroup(peers.groupBy(*keys)).applyInPandas(_accumulate, "lang string, peer int, sums array<bigint>")
    pairs = sums.select("lang", "peer", F.posexplode("sums").alias("other", "value")).where("peer <> other")
    pairs = pairs.groupBy("lang", "peer", "other").agg(F.sum("value").alias("value"))
    names = sources.select("lang", "peer", "source")
    pairs = pairs.join(names, ["lang", "peer"]).join(names.select("lang", F.col("peer").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = F.col("p") - _rate(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = numbered.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), used AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM texts) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM texts) GROUP BY ALL HAVING count(*) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM texts
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), rates AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM cells
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL)
), gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
  UNION ALL
  SELECT r.lang, r.source, 'term', r.term, r.p - w.q FROM rates r JOIN whole w ON r.lang = w.lang AND r.term = w.term
  WHERE r.n > 0 AND r.p > w.q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": _SQL}

"""Mixing by soft membership: document rates whose expected domain token totals meet targets.

Two models of the words that a text holds, learned from the label table (toxic or not, good or poor) and calibrated on
labelled documents that they have not seen, give every document a posterior over the domains ``good``, ``poor`` and
``toxic``. Projected-gradient least squares then moves nonnegative rates (expected copies of a document) away from 1 until
the expected tokens of each domain match their targets. DataFrame operations only; the driver sees domain totals and score
counts of a bounded number of bins, nothing per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import read_table, staged

DOMAINS = ("good", "poor", "toxic")
FLAGS = ("toxic", "good")
TARGETS = {"good": 0.85, "poor": 0.15, "toxic": 0.0}
#: About so many labelled documents train the word model (a hash threshold).
TRAIN_DOCS = 20_000
#: Words are hashed to so many buckets; the model has one row per bucket at most.
BUCKETS = 1 << 18
SMOOTH = 0.5
#: A word counts if its log likelihood ratio is so many standard errors from zero.
SURE = 3.0
#: Scores (over the root of the token count, as long texts hold more words of either kind) are counted in tenths from -SPAN to SPAN.
SPAN = 10.0
BINS = int(20 * SPAN) + 1
#: One posterior for each pair of score bins.
MOST_POSTERIORS = BINS * BINS
#: A token is a run of letters or a run of other characters without white space.
TOKEN = r"\\p{L}+|[^\\p{L}\\s]+"


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the token count and a row per distinct hashed word ``bucket`` (null if the text has no token)."""
    parts = docs.select(*keep, F.expr(f"regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}', 0)").alias("parts"))
    spread = parts.select(*keep, F.size("parts").alias("tokens"), F.explode_outer(F.array_distinct("parts")).alias("word"))
    bucket = F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).cast("int")
    return spread.select(*keep, "tokens", bucket.alias("bucket"))


def labelled_rows(labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, toxic, good`` (0 or 1) of about ``train_docs`` labelled documents; of several labels of one id the worst holds."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic"), (F.min("quality") > 0).cast("int").alias("good"))
    share = train_docs / max(known.count(), 1)
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share) * 1_000_000)


def word_scores(docs: DataFrame, model: DataFrame, *keep: str) -> DataFrame:
    """Per distinct ``keep``: the token count and, for either label, the sum of the weights of its distinct words over the root of
    the token count."""
    scored = words_of(docs, *keep).join(F.broadcast(model), "bucket", "left")  # at most BUCKETS rows
    root = F.sqrt(F.greatest(F.max("tokens"), F.lit(1)))
    sums = [(F.sum(F.coalesce(c, F.lit(0.0))) / root).alias(c) for c in FLAGS]
    return scored.groupBy(*keep).agg(F.max("tokens").alias("tokens"), *sums)


def score_bin(c: str) -> Column:
    return F.floor((F.greatest(F.least(F.round(F.col(c), 6), F.lit(SPAN)), F.lit(-SPAN)) + SPAN) * 10).cast("int")


def rising(counts: dict[int, tuple[int, int]], base: float) -> list[float]:
    """Chance of a label per score bin, never falling with the score: neighbouring bins that fall are pooled."""
    pools: list[list[float]] = []  # first bin, rows, rows with the label
    for b in sorted(counts):
        pools.append([b, *counts[b]])
        while len(pools) > 1 and pools[-1][2] * pools[-2][1] <= pools[-2][2] * pools[-1][1]:
            _, n, k = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += k
    out, value = [], None
    for b in range(BINS):
        while pools and pools[0][0] <= b:
            _, n, k = pools.pop(0)
            value = (k + 0.5 * base) / (n + 0.5)
        out.append(value)
    first = next((v for v in out if v is not None), base)
    return [first if v is None else v for v in out]


def word_model(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, dict[str, list[float]]]:
    """``bucket, toxic, good``: log likelihood ratio of either label per bucket (at most ``BUCKETS`` rows); and per label the
    chance of it in every score bin, counted on labelled documents that had no part in the ratios."""
    chosen = labelled_rows(labels, train_docs).withColumn("second", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 1)
    training = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by train_docs
    training = staged(training, "labelled")
    first, second = training.where("not second"), training.where("second")
    seen = first.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FLAGS]).first()
    counts = words_of(first, *FLAGS).where("bucket is not null").groupBy("bucket")
    counts = counts.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in FLAGS])

    def weight(c: str) -> Column:
        with_label = (F.col(c) + SMOOTH) / F.lit(seen[c] + 2 * SMOOTH)
        without = (F.col("n") - F.col(c) + SMOOTH) / F.lit(seen["n"] - seen[c] + 2 * SMOOTH)
        ratio = F.log(with_label / without)
        error = F.sqrt(1 / (F.col(c) + SMOOTH) + 1 / (F.col("n") - F.col(c) + SMOOTH))
        return F.when(F.abs(ratio) >= SURE * error, ratio).otherwise(0.0).alias(c)

    model = counts.select("bucket", *map(weight, FLAGS)).where(" or ".join(f"{c} <> 0" for c in FLAGS))
    model = staged(model, "words")
    tested = word_scores(second.withColumnsRenamed({c: f"is_{c}" for c in FLAGS}), model, "doc_id", *[f"is_{c}" for c in FLAGS])
    bins = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), score_bin(c).alias("bin"), F.col(f"is_{c}").alias("k")) for c in FLAGS])).alias("b")
    rows = tested.select(bins).groupBy("b.label", "b.bin").agg(F.count("*").alias("n"), F.sum("b.k").alias("k")).collect()
    chances = {}
    for c in FLAGS:
        base = (seen[c] + SMOOTH) / (seen["n"] + 2 * SMOOTH)
        chances[c] = rising({r["bin"]: (r["n"], r["k"]) for r in rows if r["label"] == c}, base)
    return model, chances


def posteriors(docs: DataFrame, model: DataFrame, chances: dict[str, list[float]]) -> DataFrame:
    """``doc_id, row, tokens`` and ``p_<domain>``; a text without words scores 0. Equal rows are one."""
    found = word_scores(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), model, "doc_id", "row")
    toxic, good = (F.element_at(F.array(*map(F.lit, chances[c])), score_bin(c) + 1) for c in FLAGS)
    return found.select("doc_id", "row", "tokens", toxic.alias("toxic"), good.alias("good")).select(
        "doc_id", "row", "tokens", F.expr("(1 - toxic) * good").alias("p_good"), F.expr("(1 - toxic) * (1 - good)").alias("p_poor"), F.col("toxic").alias("p_toxic")
    )


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Small symmetric system by elimination; a domain without tokens gets 0."""
    n = len(b)
    rows = [[*r, v] for r, v in zip(a, b)]
    for k in range(n):
        pivot = max(range(k, n), key=lambda r: abs(rows[r][k]))
        rows[k], rows[pivot] = rows[pivot], rows[k]
        if abs(rows[k][k]) < 1e-300:
            continue
        for r in range(n):
            if r != k:
                f = rows[r][k] / rows[k][k]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[k])]
    return [rows[k][n] / rows[k][k] if abs(rows[k][k]) >= 1e-300 else 0.0 for k in range(n)]


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, steps: int = 20_000, ridge: float = 0.0, tolerance: float = 1e-10) -> DataFrame:
    """``members(tokens, p_<domain>, ...)`` with ``rate``, the same for equal posteriors.

    Projected gradient descent on the squared gap between expected and wanted tokens per domain, measured by the inverse
    second moments of the posteriors so that a step of length 1 is right, plus ``ridge`` times the squared distance of the
    rates from 1 (both token-weighted). All documents of one posterior have one gradient, so the documents are summed by
    posterior once, over the cluster; posteriors come out of score bins, which bounds them by ``MOST_POSTERIORS``. The steps, with
    momentum that restarts when the gap grows, go over these sums until the gap changes by less than ``tolerance`` of all
    tokens in fifty steps.
    """
    names = [f"p_{d}" for d in targets]
    sums = members.groupBy(*names).agg(F.sum(F.col("tokens").cast("double")).alias("tokens")).orderBy(*names).limit(MOST_POSTERIORS + 1).collect()
    if len(sums) > MOST_POSTERIORS:
        raise ValueError(f"more than {MOST_POSTERIORS} different posteriors: bin them")
    cells = [([r[n] for n in names], r["tokens"] or 0.0) for r in sums]
    every = sum(t for _, t in cells)
    rates = [1.0] * len(cells)
    if every:
        share = sum(targets.values())
        wanted = [(budget if budget is not None else every) * x / share for x in targets.values()]
        rates = _descend(cells, wanted, every, steps, ridge, tolerance)
    rows = [(*p, r) for (p, _), r in zip(cells, rates)]
    table = members.sparkSession.createDataFrame(rows, ", ".join(f"_{n} double" for n in names) + ", rate double")
    same = F.lit(True)
    for n in names:
        same = same & members[n].eqNullSafe(table[f"_{n}"])
    kept = [c for c in members.columns if c != "rate"]
    # MOST_POSTERIORS rows at most
    return members.join(F.broadcast(table), same).select(*[members[c] for c in kept], "rate")


def _descend(cells: list[tuple[list[float], float]], wanted: list[float], every: float, steps: int, ridge: float, tolerance: float) -> list[float]:
    """Rates of the cells ``(posterior, tokens)``."""
    k = range(len(wanted))
    second = [[sum(t * p[i] * p[j] for p, t in cells) + (1e-9 * every if i == j else 0.0) for j in k] for i in k]
    inverse = list(zip(*[_solve(second, [float(i == j) for j in k]) for i in k]))

    def gap(rates: list[float]) -> list[float]:
        out = [-w for w in wanted]
        for (p, t), r in zip(cells, rates):
            for i in k:
                out[i] += t * r * p[i]
        return out

    def loss(g: list[float], rates: list[float]) -> float:
        near = ridge * sum(t * (r - 1.0) ** 2 for (_, t), r in zip(cells, rates)) if ridge else 0.0
        return sum(g[i] * inverse[i][j] * g[j] for i in k for j in k) + near

    rates = ahead = [1.0] * len(cells)
    momentum, best, checked = 1.0, loss(gap(rates), rates), None
    for step in range(steps):
        g = gap(ahead)
        pull = [sum(inverse[i][j] * g[j] for j in k) for i in k]
        moved = [max(0.0, y - (sum(a * b for a, b in zip(p, pull)) + ridge * (y - 1.0)) / (1.0 + ridge)) for (p, _), y in zip(cells, ahead)]
        left = gap(moved)
        now = loss(left, moved)
        if now > best and momentum > 1.0:  # overshot: start anew from the last rates
            momentum, ahead = 1.0, rates
            continue
        grown = (1.0 + math.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
        ahead = [m + (momentum - 1.0) / grown * (m - r) for m, r in zip(moved, rates)]
        rates, momentum, best = moved, grown, min(now, best)
        if step % 50 == 0:
            if checked is not None and max(abs(x - y) for x, y in zip(left, checked)) <= tolerance * every:
                break
            checked = left
    return rates


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, row, tokens, p_good, p_poor, p_toxic, rate`` of the distinct rows of ``docs``; ``row`` is the hash of the text.

    ``targets`` are shares of ``budget`` (all tokens unless given). A null or empty text has no tokens and the
    posterior of a score of 0. Without labels the model is flat (toxic and good are even odds); an empty table gives an empty result. Equal rows get one rate.
    Other columns are not read.
    """
    model, chances = word_model(docs, labels, train_docs)
    members = staged(posteriors(docs, model, chances), "posteriors")
    return fit_rates(members, targets or TARGETS, budget)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("row")


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}

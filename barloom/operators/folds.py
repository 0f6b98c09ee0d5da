"""Row numbers, time-ordered folds, sequences and combinatorial test groups."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.steps import SERIES, TICK_ORDER, Step, on_series
from barloom.plans.timeline import Timeline, lay_out
from barloom.schema import BARS_PER_SESSION, EMBARGO_MINUTES

MAX_FOLD_ROWS = 1_000


def indexed(df: DataFrame, order: Sequence[str] = TICK_ORDER, keys: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Exact 0-based row number in time order, over the whole table or per key."""
    tl = lay_out(df, keys, order)
    return tl.add({name: tl.pos}).finish()


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """The row count next to every row (a one-row broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


# -- sequences -------------------------------------------------------------------------------------


def sequences(cols: Sequence[str], seq_len: int, target: str = "target") -> Step:
    """History arrays of the ``seq_len`` rows before each row, their last row, and the row's own target."""

    def run(tl: Timeline) -> Timeline:
        past = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(tl.over(-seq_len, -1))
        last = F.lag(F.array(*[F.col(c).cast("double") for c in cols]), 1).over(tl.over())
        tl = tl.add({"sequence": past, "features": last, "_full": tl.pos >= seq_len})
        return tl.add({"sequence": F.when(F.col("_full"), F.col("sequence"))})._drop("_full")

    return Step(run, back=seq_len + 1)


def supervised(df: DataFrame, cols: Sequence[str], seq_len: int, target: str = "target", keys: Sequence[str] = SERIES, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Training samples; each row carries ``seq_len`` rows of history, so this multiplies the data by that."""
    out = on_series(df, sequences(cols, seq_len, target), keys, order).where("sequence IS NOT NULL")
    return out.select(*keys, *order, "sequence", "features", target)


def flat(sequence: Column) -> Column:
    return F.flatten(sequence)


# -- fold tables -----------------------------------------------------------------------------------


def chronological(df: DataFrame, ratio: float = 0.8, idx: str = "idx") -> DataFrame:
    """train/val by row number at int(ratio * rows)."""
    cut = F.floor(F.lit(ratio) * F.col("total"))
    return with_total(df).withColumn("role", F.when(F.col(idx) < cut, "train").otherwise("val")).drop("total")


def _fallback(total: Column, ratio: float = 0.8) -> Column:
    cut = F.floor(F.lit(ratio) * total)
    return F.array(F.struct(F.lit(0).cast("long").alias("fold"), F.lit(0).cast("long").alias("train_from"), cut.alias("train_to"), cut.alias("val_from"), total.alias("val_to")))


def walk_forward(df: DataFrame, train: int = 60 * BARS_PER_SESSION, test: int = 5 * BARS_PER_SESSION, idx: str = "idx") -> DataFrame:
    """Rolling folds: ``train`` rows, then ``test`` rows, moved on by ``test`` rows; one 80/20 fold if too short.

    The folds of a row follow from its number, so neither the count of folds nor a range join matters.
    """
    i, n = F.col(idx), F.col("total")
    last = F.floor((n - train - test) / test)
    lo = F.greatest(F.lit(0), F.ceil((i - train + 1) / test))
    hi = F.least(last, F.floor(i / test))
    as_train = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    val_fold = F.floor((i - train) / test)
    as_val = F.when((i >= train) & (val_fold <= last), F.array(val_fold)).otherwise(F.array().cast("array<bigint>"))
    rolling = F.concat(
        F.transform(as_train, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.transform(as_val, lambda f: F.struct(f.alias("fold"), F.lit("val").alias("role"))),
    )
    short = F.array(
        F.struct(F.lit(0).cast("long").alias("fold"), F.when(i < F.floor(F.lit(0.8) * n), "train").otherwise("val").alias("role"))
    )
    out = with_total(df).withColumn("_f", F.explode(F.when(n >= train + test, rolling).otherwise(short)))
    return out.select(*df.columns, F.col("_f.fold").alias("fold"), F.col("_f.role").alias("role"))


def anchored_table(total: DataFrame, min_train: int = 40 * BARS_PER_SESSION, test: int = 10 * BARS_PER_SESSION, folds: int = 5, least: int = BARS_PER_SESSION) -> DataFrame:
    """Expanding folds over a one-row table with ``total``; the test size shrinks to fit, but not below ``least``."""
    n = F.col("total")
    free = n - min_train
    size = F.when(free < test * folds, F.greatest(F.floor(free / folds), F.lit(least))).otherwise(F.lit(test)).cast("long")
    start = lambda k: F.lit(min_train) + k * size
    rows = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")),
        lambda k: F.struct(
            k.alias("fold"),
            F.lit(0).cast("long").alias("train_from"),
            start(k).alias("train_to"),
            start(k).alias("val_from"),
            F.least(start(k) + size, n).alias("val_to"),
        ),
    )
    usable = F.filter(rows, lambda r: r["val_to"] > r["val_from"])
    fits = (F.lit(min_train) + size) <= n
    return total.select(F.explode(F.when(fits, usable).otherwise(_fallback(n))).alias("_f")).select("_f.*")


def anchored_ratio_table(total: DataFrame, min_ratio: float = 0.5, folds: int = 5, least: int = 10) -> DataFrame:
    n = F.col("total")
    first = F.floor(n * min_ratio)
    size = F.greatest(F.floor((n - first) / folds), F.lit(least))
    rows = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")),
        lambda k: F.struct(
            k.alias("fold"),
            F.lit(0).cast("long").alias("train_from"),
            (first + k * size).alias("train_to"),
            (first + k * size).alias("val_from"),
            F.least(first + (k + 1) * size, n).alias("val_to"),
        ),
    )
    return total.select(F.explode(F.filter(rows, lambda r: r["val_to"] - r["val_from"] >= least)).alias("_f")).select("_f.*")


def assign(df: DataFrame, folds: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows of a bounded fold table's train and val ranges."""
    if folds.limit(MAX_FOLD_ROWS + 1).count() > MAX_FOLD_ROWS:
        raise ValueError("fold table too long for a range join; use a rule on the row number")
    i = F.col(idx)
    out = df.join(F.broadcast(folds), (i >= F.col("train_from")) & (i < F.col("val_to")))
    role = F.when(i < F.col("train_to"), "train").when(i >= F.col("val_from"), "val")
    return out.select(*df.columns, "fold", role.alias("role")).where("role IS NOT NULL")


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def purged(df: DataFrame, folds: int = 5, embargo_minutes: int = EMBARGO_MINUTES, idx: str = "idx", ts: str = "ts", bar: str = "bar_index") -> DataFrame:
    """Expanding train, then a validation part that starts after an embargo and, if it can, at a session open.

    The bounds of all folds are columns of one-row tables, so a row's folds follow from its own number and time.
    """
    i, at, n = F.col(idx), F.col(ts), F.col("_n")
    size = F.floor(n / (folds + 1))
    ks = range(1, folds + 1)
    start, stop = {k: n - (folds + 1 - k) * size for k in ks}, {k: n - (folds - k) * size for k in ks}
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    # the last train time of each fold, then its first session open after the embargo
    ends = df.crossJoin(F.broadcast(total)).agg(F.max("_n").alias("_n"), *[F.max(F.when(i < start[k], at)).alias(f"_end{k}") for k in ks])
    embargo = F.expr(f"INTERVAL {embargo_minutes} MINUTES")
    after = {k: (i >= start[k]) & (i < stop[k]) & (at >= F.col(f"_end{k}") + embargo) for k in ks}
    bounds = [F.max("_n").alias("_n"), *[F.max(f"_end{k}").alias(f"_end{k}") for k in ks]]
    opens = [x for k in ks for x in (F.min(F.when(after[k] & (F.col(bar) == 0), at)).alias(f"_open{k}"), F.max(after[k]).alias(f"_used{k}"))]
    table = df.crossJoin(F.broadcast(ends)).agg(*bounds, *opens)
    roles = {
        k: F.when(F.col(f"_used{k}") & (i < start[k]), "train").when(after[k] & (F.col(f"_open{k}").isNull() | (at >= F.col(f"_open{k}"))), "val")
        for k in ks
    }
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), role.alias("role")) for k, role in roles.items()])
    out = df.crossJoin(F.broadcast(table)).select(*df.columns, F.inline(F.filter(cells, lambda c: c["role"].isNotNull())))
    return out


# -- combinatorial groups --------------------------------------------------------------------------


def combinations(spark: SparkSession, groups: int = 16, test_groups: int = 8, limit: int = 200, seed: int = 42) -> DataFrame:
    """(combo, group, cut_left, cut_right): the sampled test sets, with the sides whose neighbour is not a test group.

    The table has at most ``limit * test_groups`` rows.
    """
    return spark.createDataFrame(combination_rows(groups, test_groups, limit, seed), "combo int, grp int, cut_left boolean, cut_right boolean")


def combination_rows(groups: int, test_groups: int, limit: int, seed: int) -> list[tuple[int, int, bool, bool]]:
    if not 0 < test_groups < groups:
        raise ValueError("test_groups must lie between 1 and groups - 1")
    sets = list(itertools.combinations(range(groups), test_groups))
    if 0 < limit < len(sets):
        sets = [sets[i] for i in np.random.default_rng(seed).choice(len(sets), size=limit, replace=False)]
    return [(c, g, g - 1 not in s, g + 1 not in s) for c, s in enumerate(sets) for g in s]


def group_of(idx: Column, total: Column, groups: int) -> Column:
    """Group of a row when ``total`` rows are cut at floor(g * total / groups)."""
    return F.floor(((idx + 1) * groups - 1) / total)


def group_edge(g: Column, total: Column, groups: int) -> Column:
    return F.floor(g * total / groups)


def test_membership(df: DataFrame, groups: int = 16, test_groups: int = 8, limit: int = 200, seed: int = 42, trim: int = 45, idx: str = "idx") -> DataFrame:
    """Group of each row, and how many test sets keep the row: a group's border is trimmed where its neighbour
    is not a test group.  A group has four counts of test sets, by the sides that are cut; they are literals, so membership
    is a column of the row."""
    uses = Counter((g, left, right) for _, g, left, right in combination_rows(groups, test_groups, limit, seed))
    n, i = F.col("total"), F.col(idx)
    rows = with_total(df).withColumn("grp", group_of(i, n, groups))
    inside = {True: i >= group_edge(F.col("grp"), n, groups) + trim, False: F.lit(True)}, {True: i < group_edge(F.col("grp") + 1, n, groups) - trim, False: F.lit(True)}
    kept = F.lit(0).cast("long")
    for left, right in itertools.product((False, True), repeat=2):
        counts = F.array(*[F.lit(uses[g, left, right]).cast("long") for g in range(groups)])
        kept = kept + F.when(inside[0][left] & inside[1][right], F.get(counts, F.col("grp").cast("int"))).otherwise(0)
    return rows.select(*df.columns, "grp", kept.alias("test_sets")).where("test_sets > 0")


# -- other splits ----------------------------------------------------------------------------------


def hashed_split(df: DataFrame, key: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Seeded row-level split by the hash of the key: the same rows whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn("role", F.when(share < ratio * float(1 << 32), "train").otherwise("val"))


def class_weight(df: DataFrame, label: str = "label", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Negatives over positives (at least one)."""
    y = F.col(label)
    return df.groupBy(*keys).agg((F.count_if(y == 0) / F.greatest(F.count_if(y == 1), F.lit(1))).alias("scale_pos_weight"))


def append_vector(features: Column, extra: Column) -> Column:
    return F.concat(features, extra)


def vector_names(names: Sequence[str], extra: int, prefix: str = "latent") -> list[str]:
    return [*names, *[f"{prefix}_{i}" for i in range(extra)]]

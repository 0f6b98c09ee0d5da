"""Audits: stage checks as small tables, correlation screens, leakage and variance tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import pair_corr
from barloom.operators.scaling import quantiles
from barloom.plans.steps import SERIES, TICK_ORDER, Step, on_series
from barloom.session import durable


def safe_corr(x: str, y: str) -> Column:
    """Correlation of complete pairs; fewer than three pairs or a flat side give zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    flat = (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12)
    return F.when((F.count(a) < 3) | flat, 0.0).otherwise(pair_corr(a, b))


def skew_report(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), limit: float = 0.5) -> DataFrame:
    """Population skewness per feature and whether it is high; flat features are skipped."""
    long = df.unpivot(list(keys), list(cols), "feature", "_x")
    out = long.groupBy(*keys, "feature").agg(F.skewness("_x").alias("skew"), F.stddev_pop("_x").alias("_s")).where("_s >= 1e-8")
    return out.select(*keys, "feature", "skew", (F.abs("skew") >= limit).alias("too_high"))


def feature_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Absolute correlation of each feature with the target (population moments), zero where undefined."""
    long = df.unpivot([target], list(cols), "feature", "_x").where(F.col("_x").isNotNull() & F.col(target).isNotNull())
    raw = F.covar_pop("_x", target) / (F.stddev_pop("_x") * (F.stddev_pop(target) + 1e-12) + 1e-12)
    return long.groupBy("feature").agg(F.abs(F.coalesce(raw, F.lit(0.0))).alias("score"))


def top_features(scores: DataFrame, n: int, explicit: Sequence[str] | None = None, known: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best scores, or the first ``n`` known names of an explicit list (at least two either way)."""
    if n < 2:
        raise ValueError("need at least two features")
    if explicit:
        names = [c.strip() for c in explicit if c.strip() and c.strip() in known][:n]
        if len(names) < 2:
            raise ValueError("explicit list holds fewer than two known features")
        at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature"))
        return scores.where(at > 0).withColumn("rank", at.cast("int"))
    top = scores.orderBy(F.col("score").desc(), "feature").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "feature")))


def variance_audit(df: DataFrame, cols: Sequence[str], limit: float = 1e-6) -> DataFrame:
    """Smallest and largest deviation, and the features that hardly vary."""
    long = df.unpivot([], list(cols), "feature", "_x").groupBy("feature").agg(F.stddev_pop("_x").alias("_s"))
    low = F.col("_s") <= limit
    return long.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.min("_s").alias("std_min"),
        F.max("_s").alias("std_max"),
        F.count_if(low).alias("low_variance_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(low, F.col("feature")))), ",").alias("low_variance_features"),
    )


def session_counts(df: DataFrame, exact: int | None = None, at_least: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per session and whether they match."""
    n = F.col("rows")
    ok = (n == exact) if exact is not None else (n >= (at_least or 0))
    return df.groupBy(*keys, "session_date").agg(F.count(F.lit(1)).alias("rows")).withColumn("ok", ok)


def null_audit(df: DataFrame, cols: Sequence[str], bar: str | None = "bar_index", keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a null (the first bar of a session may have one) and rows with an infinite value."""
    gap, inf = F.lit(False), F.lit(False)
    for c in cols:
        x = F.col(c).cast("double")
        gap = gap | x.isNull() | F.isnan(x)
        inf = inf | F.coalesce(F.abs(x) == float("inf"), F.lit(False))
    if bar:
        gap = gap & (F.col(bar) != 0)
    out = df.groupBy(*keys).agg(F.count_if(gap).alias("null_rows"), F.count_if(inf).alias("inf_rows"))
    return out.withColumn("ok", (F.col("null_rows") == 0) & (F.col("inf_rows") == 0))


def target_audit(df: DataFrame, target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    y = F.col(target)
    return df.groupBy(*keys).agg(
        F.count(y).alias("targets"), F.coalesce(F.bool_and(y.isin(0, 1)), F.lit(True)).alias("ok")
    )


def timestamp_audit(df: DataFrame, ts: str = "ts", arrival: str = "seq", keys: Sequence[str] = SERIES) -> DataFrame:
    """Backward steps in arrival order and repeated timestamps per series."""
    back = on_series(
        df, Step(lambda tl: tl.add({"_back": (F.col(ts) < F.lag(ts, 1).over(tl.over())).cast("int")}), back=1), keys, (arrival,)
    )
    steps = back.groupBy(*keys).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("backward_steps"))
    repeats = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("repeated"))
    out = steps.join(repeats, list(keys))
    return out.withColumn("ok", (F.col("backward_steps") == 0) & (F.col("repeated") == 0))


def zscore_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean near zero and deviation near one."""
    long = df.unpivot([], list(cols), "feature", "_x")
    out = long.groupBy("feature").agg(F.avg("_x").alias("mean"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("std"))
    return out.withColumn("ok", (F.abs("mean") <= 0.3) & F.col("std").between(0.5, 1.5))


def edge_rows(df: DataFrame, n: int = 100, keys: Sequence[str] = ("fold",), order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Last ``n`` train rows and first ``n`` validation rows per fold, numbered from 0 in time order.

    Row-number limits are applied before the shuffle.
    """
    tail = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    head = Window.partitionBy(*keys).orderBy(*order)
    last = df.where("role = 'train'").withColumn("_n", F.row_number().over(tail)).where(F.col("_n") <= n)
    first = df.where("role = 'val'").withColumn("_n", F.row_number().over(head)).where(F.col("_n") <= n)
    sizes = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    last = last.join(F.broadcast(sizes), list(keys)).withColumn("edge_pos", F.col("_k") - F.col("_n")).drop("_n", "_k")
    return last.unionByName(first.withColumn("edge_pos", (F.col("_n") - 1).cast("long")).drop("_n"))


def leakage_audit(df: DataFrame, cols: Sequence[str], target: str = "target", n: int = 100, limit: float = 0.05, keys: Sequence[str] = ("fold",), order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Correlation of each feature's last train values with the first validation targets, by position.

    When one side is shorter, the tail keeps its last and the head its first rows.  The edges are few rows per
    fold and are pinned, since both sides read them.
    """
    edges = durable(edge_rows(df, n, keys, order))
    tail, head = edges.where("role = 'train'"), edges.where("role = 'val'")
    sizes = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")).join(head.groupBy(*keys).agg(F.count(F.lit(1)).alias("_h")), list(keys))
    tail = tail.join(F.broadcast(sizes), list(keys)).withColumn("_at", F.col("edge_pos") - F.greatest(F.col("_t") - F.col("_h"), F.lit(0)))
    head = head.select(*keys, F.col("edge_pos").alias("_at"), F.col(target).cast("double").alias("_y"))
    pairs = tail.select(*keys, "_at", *[F.col(c).cast("double").alias(c) for c in cols]).join(head, [*keys, "_at"])
    long = pairs.unpivot([*keys, "_y"], list(cols), "feature", "_x")
    out = long.groupBy(*keys, "feature").agg(safe_corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    return out.select(*keys, "feature", "corr", (F.abs("corr") >= limit).alias("leaks"))


def ingest_summary(df: DataFrame, price: str = "close", stale: str = "is_stale", keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(price).isNull()).alias("null_rows"),
        F.count_if(F.coalesce(F.col(stale), F.lit(False))).alias("stale_rows"),
    )


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    keys = list(keys)
    long = df.unpivot(keys, list(cols), "feature", "_x").withColumn("_x", F.col("_x").cast("double"))
    stats = long.groupBy(*keys, "feature").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max")
    )
    q = quantiles(long, ["_x"], [0.25, 0.5, 0.75], [*keys, "feature"])
    q = q.select(*keys, "feature", *[F.get("_x_q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return stats.join(q, [*keys, "feature"])


def sample_spread(df: DataFrame, value: str = "prediction", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Mean, sample variance and deviation of repeated predictions, with a confidence of 1 / (1 + deviation)."""
    dev = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.avg(value).alias("prediction"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"),
        dev.alias("uncertainty_std"),
        (1.0 / (1.0 + dev)).alias("confidence"),
    )


def stage_report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, pass) over audit tables that carry an ``ok`` column."""
    out = None
    for name, table in checks.items():
        row = table.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("pass")).withColumn("check", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("check", "pass")

"""Scalers as parameter tables: fit on train rows per fold, join the parameters back, apply.

A parameter table has one row per fold and columns ``<feature>_<parameter>``; it is small, is checked before
it is broadcast, and can be written and read as Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import clip, finite
from barloom.plans.timeline import biggest_group
from barloom.session import durable, max_group_rows, small_side

FOLD = ("fold",)


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("role") == "train")


def join_params(df: DataFrame, params: DataFrame, keys: Sequence[str] = FOLD) -> DataFrame:
    """Rows with their fold's parameters; the fit is pinned so that it does not run again with the rows."""
    if not keys:
        return df.crossJoin(F.broadcast(durable(params)))
    return df.join(small_side(params), list(keys))


# -- exact quantiles -------------------------------------------------------------------------------


#: Bins of one narrowing pass.
BINS = 4096


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = FOLD, weight: Column | None = None) -> DataFrame:
    """Exact interpolated quantiles per key: one array column ``<feature>_q`` per feature; NaN counts as infinite.

    A group within ``barloom.maxGroupRows`` goes to the built-in aggregate, which holds a group's distinct values in memory.
    In a larger one the rows at the wanted ranks are selected by :func:`at_ranks`, which holds counts of bins only.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    base = df.select(*keys, *cols, w.cast("long").alias("_w"))
    if biggest_group(base, keys) <= max_group_rows(df.sparkSession):
        aggs = [F.percentile(c, list(qs), F.col("_w")).alias(f"{c}_q") for c in cols]
        return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)
    long = base.unpivot([*keys, "_w"], list(cols), "_feature", "_value").where("_value IS NOT NULL AND _w > 0")
    long = durable(long.withColumn("_value", F.nanvl(F.col("_value").cast("double"), F.lit(float("inf")))))
    group = [*keys, "_feature"]
    rank = F.col("_q.q") * (F.col("_n") - 1)
    wanted = long.groupBy(*group).agg(F.sum("_w").alias("_n"))
    wanted = wanted.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])))
    wanted = durable(wanted.select(*group, F.col("_q.i").alias("_i"), F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"), (rank - F.floor(rank)).alias("_share")))
    ranks = wanted.select(*group, F.explode(F.array("_lo", "_hi")).alias("_rank")).distinct()
    found = at_ranks(long, group, ranks)
    for end in ("_lo", "_hi"):
        wanted = wanted.join(found.withColumnsRenamed({"_rank": end, "_value": f"{end}_value"}), [*group, end])
    value = F.col("_lo_value") + F.when(F.col("_share") > 0, (F.col("_hi_value") - F.col("_lo_value")) * F.col("_share")).otherwise(0.0)
    arrays = wanted.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_l"))
    arrays = arrays.select(*group, F.transform("_l", lambda x: x["v"]).alias("_l"))
    wide = [F.max(F.when(F.col("_feature") == c, F.col("_l"))).alias(f"{c}_q") for c in cols]
    return arrays.groupBy(*keys).agg(*wide) if keys else arrays.agg(*wide)


def at_ranks(long: DataFrame, group: Sequence[str], ranks: DataFrame) -> DataFrame:
    """``group, _rank, _value``: the value at each 0-based rank of a group of ``long(group, _value, _w)``, without sorting its rows.

    Every rank has an interval of values that holds it. A pass counts the rows of each interval in bins (first by the power of
    two, then ``BINS`` equal parts, all combined before the shuffle) and goes on with the one bin that holds the rank. An interval is
    done when it has at most ``barloom.maxGroupRows`` rows or one value; a double has 52 bits below its power of two, so six passes
    always do. The rows left are counted by value.
    """
    group, limit = list(group), max_group_rows(long.sparkSession)
    targets = ranks.withColumns({"_from": F.lit(None).cast("double"), "_to": F.lit(None).cast("double"), "_below": F.lit(0).cast("long")})
    bounds = [*group, "_from", "_to"]

    def inside(targets: DataFrame) -> DataFrame:
        """Rows in the intervals; those of a group do not overlap, so a row is in one at most."""
        held = small_side(targets.select(*bounds).distinct().withColumnsRenamed({c: f"_of_{c}" for c in group}))
        same = F.col("_from").isNull() | F.col("_value").between(F.col("_from"), F.col("_to"))
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return long.join(held, same).select(*bounds, "_value", "_w")

    def holding(cells: DataFrame, order: str) -> DataFrame:
        """Targets with the cell that holds their rank."""
        upto = Window.partitionBy(*bounds).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("_end", F.sum("_sum").over(upto)).withColumnsRenamed({c: f"_of_{c}" for c in bounds})
        same = (F.col("_rank") - F.col("_below") >= F.col("_end") - F.col("_sum")) & (F.col("_rank") - F.col("_below") < F.col("_end"))
        for c in bounds:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        return targets.join(cells, same)

    share = (F.col("_value") - F.col("_from")) / (F.col("_to") - F.col("_from")) * BINS
    power = F.greatest(F.least(F.floor(F.log2(F.abs("_value"))), F.lit(1100)), F.lit(-1100)) + 1101
    first = F.when(F.col("_value") == 0, 0).otherwise(F.signum("_value").cast("long") * power)
    for bin_ in [first, *[F.when(F.col("_from") == F.col("_to"), 0).otherwise(F.least(F.floor(share), F.lit(BINS - 1)))] * 6]:
        cells = inside(targets).groupBy(*bounds, bin_.cast("long").alias("_bin"))
        cells = cells.agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
        below = (F.col("_below") + F.col("_end") - F.col("_sum")).alias("_below")
        found = durable(holding(cells, "_bin").select(*group, "_rank", F.col("_least").alias("_from"), F.col("_most").alias("_to"), below, "_rows"))
        targets = found.drop("_rows")
        if found.where((F.col("_from") < F.col("_to")) & (F.col("_rows") > limit)).isEmpty():
            break
    values = inside(targets).groupBy(*bounds, "_value").agg(F.sum("_w").alias("_sum"))
    return durable(holding(values, "_value").select(*group, "_rank", "_value"))


# -- clipping and imputation -----------------------------------------------------------------------


def fit_fences(df: DataFrame, cols: Sequence[str], k: float = 4.0, keys: Sequence[str] = FOLD) -> DataFrame:
    q = quantiles(df, cols, [0.25, 0.75], keys)
    out = []
    for c in cols:
        lo, hi = F.get(f"{c}_q", F.lit(0)), F.get(f"{c}_q", F.lit(1))
        out += [(lo - k * (hi - lo)).alias(f"{c}_lo"), (hi + k * (hi - lo)).alias(f"{c}_hi")]
    return q.select(*keys, *out)


def clip_fences(df: DataFrame, fences: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    out = join_params(df, fences, keys).withColumns({c: clip(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in cols})
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("lo", "hi")])


def fit_medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})
    q = quantiles(clean, cols, [0.5], keys)
    return q.select(*keys, *[F.coalesce(F.get(f"{c}_q", F.lit(0)), F.lit(0.0)).alias(f"{c}_fill") for c in cols])


def impute(df: DataFrame, medians: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    out = join_params(df, medians, keys)
    out = out.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"{c}_fill")) for c in cols})
    return out.drop(*[f"{c}_fill" for c in cols])


# -- centre and scale ------------------------------------------------------------------------------


def _unit(c: Column) -> Column:
    return F.when(c > 10 * 2.220446049250313e-16, c).otherwise(F.lit(1.0))


def fit_standard(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD, weight: Column | None = None) -> DataFrame:
    """Mean and population deviation; a flat feature scales by one.  ``weight`` counts a row several times."""
    if weight is None:
        aggs = [a for c in cols for a in (F.avg(c).alias(f"{c}_center"), _unit(F.stddev_pop(c)).alias(f"{c}_scale"))]
        return df.groupBy(*keys).agg(*aggs)
    w = weight.cast("double")
    rows = df.withColumn("_w", w).where("_w > 0")
    means = rows.groupBy(*keys).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(f"{c}_center") for c in cols])
    around = join_params(rows, means, keys)
    off = lambda c: F.col(c) - F.col(f"{c}_center")
    return around.groupBy(*keys).agg(
        *[
            a
            for c in cols
            for a in (
                F.first(f"{c}_center").alias(f"{c}_center"),
                _unit(F.sqrt(F.sum(F.col("_w") * off(c) * off(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w"))))).alias(f"{c}_scale"),
            )
        ]
    )


def fit_robust(df: DataFrame, cols: Sequence[str], low: float = 25.0, high: float = 75.0, keys: Sequence[str] = FOLD, weight: Column | None = None) -> DataFrame:
    """Median and the range between two percentiles."""
    q = quantiles(df, cols, [0.5, low / 100.0, high / 100.0], keys, weight)
    out = []
    for c in cols:
        mid, lo, hi = (F.get(f"{c}_q", F.lit(i)) for i in range(3))
        out += [mid.alias(f"{c}_center"), _unit(hi - lo).alias(f"{c}_scale")]
    return q.select(*keys, *out)


def sane_range(low: float, high: float) -> tuple[float, float]:
    """Percentile range kept inside 5..40 and 60..95 and at least ten apart."""
    low, high = min(max(low, 5.0), 40.0), min(max(high, 60.0), 95.0)
    return low, min(95.0, low + 10.0) if high <= low + 10.0 else high


def apply_scale(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD, inverse: bool = False) -> DataFrame:
    out = join_params(df, params, keys)
    move = {}
    for c in cols:
        center, scale = F.col(f"{c}_center"), F.col(f"{c}_scale")
        move[c] = F.col(c) * scale + center if inverse else (F.col(c) - center) / scale
    return out.withColumns(move).drop(*[f"{c}_{s}" for c in cols for s in ("center", "scale")])


def reload_gap(df: DataFrame, fitted: DataFrame, reloaded: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    """The reloaded parameters per key with the rows they were tried on and the largest gap to the fitted scaler's results."""
    keys, names = list(keys), [f"_{c}" for c in cols]
    twice = df.select(*keys, *cols, *[F.col(c).alias(n) for c, n in zip(cols, names)])
    there = apply_scale(twice, fitted, cols, keys)
    again = there.withColumnsRenamed({c: f"{c}_fit" for c in cols}).withColumnsRenamed(dict(zip(names, cols)))
    again = apply_scale(again, reloaded, cols, keys)
    gap = F.greatest(*[F.max(F.coalesce(F.abs(F.col(c) - F.col(f"{c}_fit")), F.lit(0.0))) for c in cols])
    if len(cols) == 1:
        gap = F.max(F.coalesce(F.abs(F.col(cols[0]) - F.col(f"{cols[0]}_fit")), F.lit(0.0)))
    return reloaded.join(again.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), gap.alias("max_gap")), keys)


def sequence_weight(row: Column, seq_len: int, samples: Column) -> Column:
    """How many of ``samples`` overlapping histories of ``seq_len`` rows hold the given row."""
    first, last = F.greatest(row + 1, F.lit(seq_len)), F.least(row + seq_len, samples + (seq_len - 1))
    return F.greatest(F.lit(0), last - first + 1)


# -- power transform -------------------------------------------------------------------------------


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The transform by one exponential: both signs use ln(1 + |x|), with exponent lambda or 2 - lambda."""
    size = F.log1p(F.abs(x))
    k = F.when(x >= 0, lam).otherwise(2.0 - lam)
    grown = F.when(F.abs(k) < 1e-12, size).otherwise(F.expm1(k * size) / k)
    return F.when(x >= 0, grown).otherwise(-grown)


#: Exponents tried on either side of a centre in one pass.
TRIALS = 5


def _best_exponents(long: DataFrame, centers: DataFrame, group: Sequence[str]) -> DataFrame:
    """Best of ``2 * TRIALS + 1`` exponents around each group's centre, the likelihoods beside it, and whether it is the last tried.

    All trial variances are columns of one aggregation; a trial that overflows has no likelihood.
    """
    tried = long.join(small_side(centers), list(group))
    trial = {i: F.col("_center") + i * F.col("_step") for i in range(-TRIALS, TRIALS + 1)}
    sums = tried.groupBy(*group, "_center", "_step").agg(
        *[F.var_pop(yeo_johnson(F.col("_x"), lam)).alias(f"_v{i + TRIALS}") for i, lam in trial.items()],
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.signum("_x") * F.log1p(F.abs("_x"))).alias("_logs"),
    )

    def likelihood(i: int) -> Column:
        v = F.col(f"_v{i + TRIALS}")
        usable = F.when((v > 0) & (v < F.lit(float("inf"))), v)
        return -F.col("_n") / 2.0 * F.log(usable) + (trial[i] - 1.0) * F.col("_logs")

    scored = sums.select(*group, "_center", "_step", F.array(*[likelihood(i) for i in trial]).alias("_like"))
    at = F.array_position("_like", F.array_max("_like")).cast("int")
    scored = scored.withColumn("_at", at)
    beside = lambda k: F.try_element_at("_like", F.when(F.col("_at") + k > 0, F.col("_at") + k))
    return scored.select(
        *group,
        "_step",
        F.coalesce(F.col("_center") + (F.col("_at") - (TRIALS + 1)) * F.col("_step"), F.lit(1.0)).alias("_center"),
        F.get("_like", F.col("_at") - 1).alias("_here"),
        beside(-1).alias("_left"),
        beside(1).alias("_right"),
        F.coalesce(F.col("_at").isin(1, 2 * TRIALS + 1), F.lit(False)).alias("_edge"),
    )


def fit_power(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD, widenings: int = 20) -> DataFrame:
    """Maximum-likelihood exponent per feature, with mean and deviation of the transformed values.

    The exponents tried are moved and spread out until the best lies between two others, then narrowed around it until
    a parabola through it and its neighbours settles it to about 1e-6 of its size. A feature whose likelihood has no
    peak raises; one without spread gets 1. Each pass is one aggregation of the pinned (key, feature, value) table.
    """
    keys = list(keys)
    group = [*keys, "_feature"]
    long = durable(df.select(*keys, *cols).unpivot(keys, list(cols), "_feature", "_x").where("_x IS NOT NULL"))
    centers = long.select(*group).distinct().withColumns({"_center": F.lit(1.0), "_step": F.lit(1.0)})
    for _ in range(widenings):
        best = durable(_best_exponents(long, centers, group))
        if best.where("_edge").isEmpty():
            break
        centers = best.select(*group, "_center", F.when(F.col("_edge"), F.col("_step") * 3).otherwise(F.col("_step")).alias("_step"))
    else:
        names = [r["_feature"] for r in best.where("_edge").select("_feature").distinct().collect()]
        raise ValueError(f"no best exponent for {', '.join(sorted(names))}")
    fine = 0.01
    while not best.where(F.col("_step") > fine * F.greatest(F.lit(1.0), F.abs("_center") / 10)).isEmpty():
        centers = best.select(*group, "_center", (F.col("_step") / 4).alias("_step"))
        best = durable(_best_exponents(long, centers, group))
    bend = F.col("_left") - 2.0 * F.col("_here") + F.col("_right")
    move = F.coalesce(F.try_divide(F.col("_left") - F.col("_right"), bend), F.lit(0.0)) * F.col("_step") / 2.0
    centers = durable(best.select(*group, (F.col("_center") + move).alias("_center")))
    fitted = long.join(small_side(centers), group)
    y = yeo_johnson(F.col("_x"), F.col("_center"))
    stats = fitted.groupBy(*group).agg(F.first("_center").alias("_lam"), F.avg(y).alias("_m"), _unit(F.stddev_pop(y)).alias("_s"))
    wide = []
    for c in cols:
        at = F.col("_feature") == c
        wide += [F.max(F.when(at, F.col(x))).alias(f"{c}_{n}") for n, x in (("lambda", "_lam"), ("center", "_m"), ("scale", "_s"))]
    return stats.groupBy(*keys).agg(*wide)


def apply_power(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    out = join_params(df, params, keys)
    move = {c: (yeo_johnson(F.col(c), F.col(f"{c}_lambda")) - F.col(f"{c}_center")) / F.col(f"{c}_scale") for c in cols}
    return out.withColumns(move).drop(*[f"{c}_{s}" for c in cols for s in ("lambda", "center", "scale")])


# -- family recipes --------------------------------------------------------------------------------


def sequence_family(df: DataFrame, price: Sequence[str], vol: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    """Recipe for sequence models: session z-scores for price-like features, imputed, fenced and power-transformed
    volatility features.  Everything is fitted on the train rows of a fold."""
    from barloom.operators.session_features import session_zscore

    group = [*keys, "role", "symbol", "session_date"]
    out = session_zscore(durable(df), list(price), keys=group)
    out = out.withColumns({c: F.col(f"{c}_z") for c in price}).drop(*[f"{c}_z" for c in price])
    return _powered(out, vol, keys)


def _powered(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    out = impute(df, fit_medians(train_rows(df), cols, keys), cols, keys)
    out = clip_fences(out, fit_fences(train_rows(out), cols, keys=keys), cols, keys)
    return apply_power(out, fit_power(train_rows(out), cols, keys), cols, keys)


def tree_family(df: DataFrame, volume: Sequence[str], greeks: Sequence[str], iv: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    """Recipe for tree models: robust volumes (missing is zero, fenced), standard greeks (imputed), power-transformed
    volatilities."""
    out = durable(df).withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in volume})
    out = clip_fences(out, fit_fences(train_rows(out), volume, keys=keys), volume, keys)
    out = apply_scale(out, fit_robust(train_rows(out), volume, keys=keys), volume, keys)
    out = impute(out, fit_medians(train_rows(out), greeks, keys), greeks, keys)
    out = apply_scale(out, fit_standard(train_rows(out), greeks, keys), greeks, keys)
    return _powered(out, iv, keys)

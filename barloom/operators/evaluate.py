"""Evaluation of prediction tables (idx, y_true, y_pred and optional keys such as model or fold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.custom import normal_cdf
from barloom.operators.folds import combinations, group_edge, group_of
from barloom.operators.matrix import hurst
from barloom.operators.session_features import drawdowns
from barloom.plans.timeline import lay_out
from barloom.schema import ANNUAL_BARS, TRADING_DAYS

# Cost assumptions in basis points and the group scheme of the cross-validation.
COMMISSION, SLIPPAGE, IMPACT = 2.0, 1.0, 0.5
GROUPS, TEST_GROUPS, MAX_COMBINATIONS, PURGE, EMBARGO, SEED = 16, 8, 200, 30, 15, 42
FLAT = 1e-12


def by(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys)


def pair_up(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join result tables on the keys; without keys both have one row."""
    return a.join(b, list(keys)) if keys else a.crossJoin(b)


def sign_hit(y: str = "y_true", p: str = "y_pred") -> Column:
    return (F.signum(y) == F.signum(p)).cast("double")


# -- point metrics ---------------------------------------------------------------------------------


def errors(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return by(df, keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(sign_hit()).alias("directional_accuracy"),
    )


def trade(df: DataFrame, commission: float = COMMISSION, slippage: float = SLIPPAGE, impact: float = IMPACT, always_in: bool = False) -> DataFrame:
    """Gross and net result per row; ``always_in`` goes long on a zero prediction instead of staying out."""
    side = F.when(F.col("y_pred") >= 0, 1.0).otherwise(-1.0) if always_in else F.signum("y_pred")
    cost = (2.0 * commission + slippage + impact) / 10_000.0
    gross = side * F.col("y_true")
    return df.withColumns({"gross_pnl": gross, "pnl": gross - F.abs(side) * cost})


def _sharpe(n: Column, mean: Column, dev: Column, annual: float) -> Column:
    return F.when((n < 2) | dev.isNull() | (dev <= FLAT), 0.0).otherwise(mean / dev * F.sqrt(F.lit(annual)))


def sharpe(df: DataFrame, keys: Sequence[str] = (), annual: float = TRADING_DAYS, r: str = "pnl", idx: str = "idx") -> DataFrame:
    """Annualised Sharpe ratio; a finer annualisation first sums rows to days by row number."""
    keys = list(keys)
    total = by(df, keys).agg(F.count(F.lit(1)).alias("_rows"))
    rows = df
    if annual > TRADING_DAYS:
        per_day = int(annual / TRADING_DAYS)
        rows = df.groupBy(*keys, F.floor(F.col(idx) / per_day).alias("_day")).agg(F.sum(r).alias(r))
    out = by(rows, keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    annual = min(annual, TRADING_DAYS)
    value = F.when(F.col("_rows") < 2, 0.0).otherwise(_sharpe(F.col("_n"), F.col("_m"), F.col("_s"), annual))
    return pair_up(out, total, keys).select(*keys, value.alias("sharpe_ratio"))


def sortino_of(r: str = "pnl", annual: float = TRADING_DAYS) -> Column:
    down = F.when(F.col(r) < 0, F.col(r))
    return F.when(F.count(down) < 2, 0.0).otherwise(F.avg(r) / (F.stddev_pop(down) + FLAT) * F.sqrt(F.lit(annual)))


def trade_stats(r: str = "pnl") -> list[Column]:
    x = F.col(r)
    trades, wins, losses = F.count_if(x != 0), F.count_if(x > 0), F.count_if(x < 0)
    won, lost = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)))
    factor = F.when(lost != 0, F.try_divide(won, lost)).when(won > 0, float("inf")).otherwise(0.0)
    return [
        F.when(trades > 0, wins / F.greatest(trades, F.lit(1))).otherwise(0.0).alias("win_rate"),
        factor.alias("profit_factor"),
        F.coalesce(F.avg(F.when(x != 0, x)), F.lit(0.0)).alias("expectancy"),
        F.count(x).alias("total_trades"),
        wins.alias("winning_trades"),
        losses.alias("losing_trades"),
    ]


def curve(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """Rows with equity, peak, drawdown and the length of the losing run each row ends."""
    tl = lay_out(df, keys, (idx,))
    loss = F.coalesce(F.col("pnl") < 0, F.lit(False))
    tl = tl.running({"equity": ("sum", F.col("pnl")), "_kept": ("last", F.when(~loss, tl.pos))})
    tl = tl.running({"peak": ("max", F.col("equity"))})
    run = F.when(loss, tl.pos - F.coalesce(F.col("_kept"), F.lit(-1))).otherwise(F.lit(0))
    return tl.add({"drawdown": F.col("equity") - F.col("peak"), "losing_run": run}).finish("_kept")


def calmar_of(idx: str = "idx") -> Column:
    """Equity change over the deepest drawdown, inside an aggregation over ``curve`` rows."""
    deepest = F.abs(F.min("drawdown"))
    gain = F.max_by("equity", idx) - F.min_by("equity", idx)
    return F.when(deepest == 0, 0.0).otherwise(F.try_divide(gain, deepest))


def backtest(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", commission: float = COMMISSION, slippage: float = SLIPPAGE, impact: float = IMPACT, with_cpcv: bool = True) -> DataFrame:
    """All metrics in one row per key, with the cross-validation distribution as a struct.

    One pass lays out the equity curve; every metric is an aggregate over it.
    """
    keys = list(keys)
    rows = curve(trade(df, commission, slippage, impact), keys, idx)
    e = F.col("y_true") - F.col("y_pred")
    n = F.count(F.lit(1))
    out = by(rows, keys).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(sign_hit()).alias("directional_accuracy"),
        F.sum("pnl").alias("total_pnl_proxy"),
        F.sum("gross_pnl").alias("gross_total_pnl_proxy"),
        F.min("drawdown").alias("max_drawdown_proxy"),
        *trade_stats(),
        F.max("losing_run").alias("max_consecutive_losses"),
        _sharpe(n, F.avg("pnl"), F.stddev_samp("pnl"), TRADING_DAYS).alias("sharpe_ratio"),
        sortino_of().alias("sortino_ratio"),
        calmar_of(idx).alias("calmar_ratio"),
    )
    out = out.withColumns({"commission_bps": F.lit(commission), "slippage_bps": F.lit(slippage), "market_impact_bps": F.lit(impact)})
    if not with_cpcv:
        return out
    dist = cpcv(df, keys, idx)
    fields = [c for c in dist.columns if c not in keys]
    return pair_up(out, dist.select(*keys, F.struct(*fields).alias("cpcv")), keys)


# -- combinatorial cross-validation ----------------------------------------------------------------


def _cells(df: DataFrame, keys: Sequence[str], idx: str, groups: int, trim: int) -> DataFrame:
    """Sufficient statistics per group for the four ways its borders may be trimmed."""
    totals = by(df, keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = df.join(F.broadcast(totals), list(keys)) if keys else df.crossJoin(F.broadcast(totals))
    n, i = F.col("_total"), F.col(idx)
    rows = rows.where(n >= groups).withColumn("grp", group_of(i, n, groups))
    first, end = group_edge(F.col("grp"), n, groups), group_edge(F.col("grp") + 1, n, groups)
    rows = rows.withColumns(
        {"_l": i >= first + trim, "_r": i < end - trim, "_hit": sign_hit(), "_pnl": F.signum("y_pred") * F.col("y_true")}
    )
    cases = [(a, b) for a in (False, True) for b in (False, True)]
    aggs = []
    for c, (a, b) in enumerate(cases):
        inside = (F.col("_l") | F.lit(not a)) & (F.col("_r") | F.lit(not b))
        p = F.when(inside, F.col("_pnl"))
        aggs += [F.count(p).alias(f"_n{c}"), F.sum(F.when(inside, F.col("_hit"))).alias(f"_h{c}"), F.sum(p).alias(f"_s{c}"), F.sum(p * p).alias(f"_q{c}")]
    wide = rows.groupBy(*keys, "grp").agg(*aggs)
    stacked = F.array(
        *[
            F.struct(F.lit(a).alias("cut_left"), F.lit(b).alias("cut_right"), *[F.col(f"_{x}{c}").cast("double").alias(x) for x in "nhsq"])
            for c, (a, b) in enumerate(cases)
        ]
    )
    return wide.select(*keys, "grp", F.inline(stacked))


def cpcv_combinations(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", groups: int = GROUPS, test_groups: int = TEST_GROUPS, limit: int = MAX_COMBINATIONS, trim: int = PURGE + EMBARGO, seed: int = SEED) -> DataFrame:
    """Accuracy and Sharpe ratio of every sampled test set: at most ``limit * test_groups`` joined rows per key."""
    cells = _cells(df, keys, idx, groups, trim)
    sets = combinations(df.sparkSession, groups, test_groups, limit, seed)
    joined = cells.join(F.broadcast(sets), ["grp", "cut_left", "cut_right"])
    sums = joined.groupBy(*keys, "combo").agg(*[F.sum(x).alias(x) for x in "nhsq"]).where(F.col("n") >= max(groups, 16))
    mean = F.col("s") / F.col("n")
    dev = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select(
        *keys,
        "combo",
        F.col("n").cast("long").alias("test_rows"),
        (F.col("h") / F.col("n")).alias("directional_accuracy"),
        F.when(dev <= FLAT, 0.0).otherwise(mean / (dev + FLAT) * F.sqrt(F.lit(TRADING_DAYS))).alias("sharpe"),
    )


def cpcv(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", **scheme) -> DataFrame:
    """Distribution over the test sets with the chance of a negative Sharpe ratio under a normal fit."""
    keys = list(keys)
    combos = cpcv_combinations(df, keys, idx, **scheme)
    lo_hi = lambda c: F.percentile(c, [0.025, 0.975])
    agg = by(combos, keys).agg(
        F.count(F.lit(1)).alias("n_combinations_evaluated"),
        F.avg("directional_accuracy").alias("directional_accuracy_mean"),
        F.stddev_pop("directional_accuracy").alias("directional_accuracy_std"),
        lo_hi("directional_accuracy").alias("_d"),
        F.avg("sharpe").alias("sharpe_mean"),
        F.stddev_pop("sharpe").alias("sharpe_std"),
        lo_hi("sharpe").alias("_s"),
    )
    # Keys without a valid test set still get a row.
    base = by(df, keys).agg(F.count(F.lit(1)).alias("_rows"))
    agg = base.join(agg, keys, "left") if keys else base.crossJoin(agg)
    mean, dev = F.col("sharpe_mean"), F.col("sharpe_std")
    some = F.coalesce(F.col("n_combinations_evaluated"), F.lit(0)) > 0
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    pbo = (
        F.when(~some, 1.0)
        .when(dev > FLAT, normal_cdf(F.try_divide(-mean, dev)))
        .when(mean < 0, 1.0)
        .otherwise(0.0)
    )
    return agg.select(
        *keys,
        F.coalesce("n_combinations_evaluated", F.lit(0)).alias("n_combinations_evaluated"),
        zero("directional_accuracy_mean"),
        zero("directional_accuracy_std"),
        at("_d", 0).alias("directional_accuracy_ci95_low"),
        at("_d", 1).alias("directional_accuracy_ci95_high"),
        zero("sharpe_mean"),
        zero("sharpe_std"),
        at("_s", 0).alias("sharpe_ci95_low"),
        at("_s", 1).alias("sharpe_ci95_high"),
        pbo.alias("pbo_proxy"),
    )


# -- folds and probabilities -----------------------------------------------------------------------


def threshold_labels(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """Predicted label at a threshold kept inside 0.35..0.65, and the long/short return it earns."""
    cut = min(max(threshold, 0.35), 0.65)
    label = (F.col(prob) >= cut).cast("int")
    return df.withColumns({"pred_label": label, "pnl": F.when(label == 1, 1.0).otherwise(-1.0) * F.col("ret")})


def classification(df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Metrics of probabilities (prob, label, ret)."""
    rows = threshold_labels(df, threshold)
    e = F.col("label") - F.col("prob")
    return by(rows, keys).agg(
        F.count(F.lit(1)).alias("val_samples"),
        F.avg(e * e).alias("val_mse"),
        F.avg(F.abs(e)).alias("val_mae"),
        F.sqrt(F.avg(e * e)).alias("val_rmse"),
        F.avg((F.col("pred_label") == F.col("label")).cast("double")).alias("val_directional_accuracy"),
        F.avg("pnl").alias("val_strategy_mean_return"),
        F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("val_strategy_std_return"),
        F.avg("label").alias("val_positive_rate"),
        F.avg("pred_label").alias("val_pred_positive_rate"),
    )


def fold_metrics(df: DataFrame, threshold: float = 0.5, fold: str = "fold", idx: str = "idx") -> DataFrame:
    """Per fold: Sharpe ratio over days, accuracy, loss and deepest compounded drawdown.  ``idx`` restarts per fold."""
    rows = threshold_labels(df, threshold)
    e = F.col("label") - F.col("prob")
    base = rows.groupBy(fold).agg(F.avg((F.col("pred_label") == F.col("label")).cast("double")).alias("dir_acc"), F.avg(e * e).alias("loss"))
    dd = drawdowns(rows.select(fold, idx, "pnl"), keys=(fold,), order=(idx,)).groupBy(fold).agg(F.max("drawdown_ratio").alias("drawdown"))
    ratio = sharpe(rows, (fold,), ANNUAL_BARS, idx=idx).withColumnRenamed("sharpe_ratio", "sharpe")
    return base.join(dd, fold).join(ratio, fold)


def walk_forward_summary(folds: DataFrame, fold: str = "fold") -> DataFrame:
    """One row over a bounded fold table."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(fold, c))), lambda s: s[c])
    return folds.agg(
        F.percentile("sharpe", 0.05).alias("wf_sharpe_p5"),
        F.avg("sharpe").alias("wf_sharpe_mean"),
        F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("wf_sharpe_std"),
        F.avg("dir_acc").alias("wf_dir_acc_mean"),
        F.avg("loss").alias("wf_loss_mean"),
        F.greatest(F.max("drawdown"), F.lit(0.0)).alias("wf_max_drawdown_ratio"),
        F.count(F.lit(1)).alias("wf_n_folds"),
        listed("sharpe").alias("wf_fold_sharpes"),
        listed("drawdown").alias("wf_fold_drawdowns"),
    )


def log_loss_auc(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob", label: str = "label") -> DataFrame:
    """Log-loss, and the area under the ROC curve with ties counted half.

    Rows are first reduced to counts per distinct probability; the ranks come from a running sum over those.
    """
    keys = list(keys)
    p = F.greatest(F.least(F.col(prob), F.lit(1.0 - 1e-15)), F.lit(1e-15))
    loss = by(df, keys).agg(F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1.0 - p))).alias("log_loss"))
    steps = df.groupBy(*keys, prob).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n"))
    steps = lay_out(steps, keys, (prob,)).running({"_below": ("sum", F.col("_n"))}).finish()
    won = F.col("_p").cast("double") * (F.col("_below") - F.col("_n") / 2.0)
    auc = by(steps, keys).agg(F.try_divide(F.sum(won), F.sum("_p").cast("double") * F.sum("_n")).alias("auc"))
    return pair_up(loss, auc, keys)


def directional_huber(df: DataFrame, keys: Sequence[str] = (), delta: float = 1.0, weight: float = 1.0) -> DataFrame:
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    huber = F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))
    wrong = F.greatest(-F.col("y_pred") * F.col("y_true"), F.lit(0.0))
    return by(df, keys).agg((F.avg(huber) + weight * F.avg(wrong)).alias("loss"))


# -- forecast combination --------------------------------------------------------------------------


def blend_weights(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), y: str = "y_true") -> DataFrame:
    """Variance-covariance weights of two forecasts, kept inside 0..1; equal when they cannot be told apart."""
    ea, eb = F.col(y) - F.col(a), F.col(y) - F.col(b)
    agg = by(df, keys).agg(F.var_pop(ea).alias("_va"), F.var_pop(eb).alias("_vb"), F.covar_samp(ea, eb).alias("_c"))
    gap = F.col("_va") + F.col("_vb") - 2.0 * F.col("_c")
    w = F.greatest(F.least(F.try_divide(F.col("_vb") - F.col("_c"), gap), F.lit(1.0)), F.lit(0.0))
    w = F.when(gap < FLAT, 0.5).otherwise(w)
    return agg.select(*keys, w.alias("weight_a"), (1.0 - w).alias("weight_b"))


def regime_blend(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), idx: str = "idx", y: str = "y_true", recent: int = 100) -> tuple[DataFrame, DataFrame]:
    """Blend shifted by the persistence of the last targets: (blended rows, one report row per key)."""
    keys = list(keys)
    base = blend_weights(df, a, b, keys, y)
    total = by(df, keys).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = df.join(F.broadcast(total), keys) if keys else df.crossJoin(F.broadcast(total))
    tail = numbered.where(F.col(idx) >= F.col("_rows") - recent)
    if not keys:
        tail = tail.withColumn("_all", F.lit(0))
    h = hurst(tail, y, keys or ["_all"], (idx,))
    h = h if keys else h.drop("_all")
    shift = F.col("weight_a") + (F.col("hurst") - 0.5) * 2.0
    final = F.greatest(F.least(shift, F.lit(1.0)), F.lit(0.0))
    weights = pair_up(base, h, keys).select(*keys, F.col("weight_a").alias("optimal_weight_a"), "hurst", final.alias("final_weight_a"))
    rows = df.join(F.broadcast(weights), keys) if keys else df.crossJoin(F.broadcast(weights))
    rows = rows.withColumn("blended", F.col(a) * F.col("final_weight_a") + F.col(b) * (1.0 - F.col("final_weight_a")))
    sq = lambda c: (F.col(y) - F.col(c)) * (F.col(y) - F.col(c))
    report = by(rows, keys).agg(
        F.first("optimal_weight_a").alias("optimal_weight_a"),
        F.first("hurst").alias("hurst"),
        F.first("final_weight_a").alias("final_weight_a"),
        F.avg(sq("blended")).alias("hybrid_mse"),
        F.avg(F.abs(F.col(y) - F.col("blended"))).alias("hybrid_mae"),
        F.avg(sign_hit(y, "blended")).alias("hybrid_directional_accuracy"),
        F.avg(sq(a)).alias("base_mse"),
    )
    cut = (F.col("base_mse") - F.col("hybrid_mse")) / (F.col("base_mse") + FLAT) * 100.0
    return rows.drop("optimal_weight_a", "hurst", "final_weight_a"), report.withColumn("residual_reduction_pct", cut)


def residuals(df: DataFrame, first: str, second: str, y: str = "y_true") -> DataFrame:
    """Residual target of the first forecast and the additive hybrid of both."""
    return df.withColumns({"residual": F.col(y) - F.col(first), "hybrid": F.col(first) + F.col(second)})


def scored(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    e = F.col(target) - F.col(prediction)
    return df.withColumns({"error": e, "abs_error": F.abs(e)})


def compare_models(df: DataFrame, model: str = "model", idx: str = "idx", horizon: int = 1) -> DataFrame:
    """Metrics per model with the model of the lowest overfitting proxy marked."""
    dist = cpcv(df, (model,), idx, trim=max(2 * horizon, 2) + max(horizon, 1))
    raw = df.withColumn("pnl", F.signum("y_pred") * F.col("y_true"))
    out = errors(df, (model,)).join(sharpe(raw, (model,), idx=idx), model).join(dist.select(model, "pbo_proxy"), model)
    best = out.agg(F.min_by(model, F.struct("pbo_proxy", model)).alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("lowest_pbo", F.col(model) == F.col("_best")).drop("_best")

"""Matrix, evaluation, trial and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.alignment import SYMBOLS
from barloom.catalog.base import NUDGE, TICKS, query, sql
from barloom.catalog.sessions import FILLED, filled
from barloom.functions.custom import normal_cdf, rolling_apply
from barloom.operators import evaluate as ev
from barloom.operators import folds, matrix, models, trials
from barloom.operators import indicators as ind
from barloom.plans import pipeline
from barloom.plans.steps import Step, on_series
from barloom.session import durable

# -- matrices --------------------------------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(SYMBOLS) for b in SYMBOLS[i + 1 :]]
PAIR_NAMES = [matrix.pair_name(a, b) for a, b in PAIRS]
ALL_FINITE = " AND ".join(f"coalesce(isfinite({c}), false)" for c in PAIR_NAMES)
W20 = "OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
RETURNS = f"""{FILLED}, lr0 AS (SELECT ts, symbol, price, lag(price) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM filled),
lr AS (SELECT ts, symbol, ln(price / greatest(b, 1e-8)) AS ret FROM lr0 WHERE b IS NOT NULL),
wd AS (SELECT ts, {', '.join(f"max(ret) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS)} FROM lr GROUP BY ts HAVING count(ret) > 0),
rc AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, {', '.join(f'corr({a}, {b}) {W20} AS {matrix.pair_name(a, b)}' for a, b in PAIRS)} FROM wd),
cr AS (SELECT ts, {', '.join(f'CASE WHEN isfinite({c}) AND {ALL_FINITE} THEN {c} ELSE 0 END AS {c}' for c in PAIR_NAMES)} FROM rc WHERE rn >= 20)"""


def correlations(t):
    from barloom.operators.session_features import panel_returns

    wide = panel_returns(filled(t)).groupBy("ts").pivot("symbol", SYMBOLS).agg(F.first("ret"))
    return matrix.rolling_correlations(wide, SYMBOLS, 20)


@query("mat_01", sql(f"{RETURNS}, final AS (FROM cr)", "ts", " ".join(PAIR_NAMES)))
def _correlations(t):
    return correlations(t)


def deg(a: str) -> str:
    cells = [matrix.pair_name(*sorted((a, b))) for b in SYMBOLS if b != a]
    return f"greatest(2 + {' + '.join(cells)}, 1e-6)"


ADJACENT = [(a, b) for i, a in enumerate(SYMBOLS) for b in SYMBOLS[i:]]
DEGREES = ", ".join(f"{deg(s)} AS degree_{s}" for s in SYMBOLS)
NORMED = ", ".join(f"{2 if a == b else matrix.pair_name(a, b)} / sqrt(degree_{a} * degree_{b}) AS adj_{a}__{b}" for a, b in ADJACENT)
ADJ_COLS = [*(f"degree_{s}" for s in SYMBOLS), *(f"adj_{a}__{b}" for a, b in ADJACENT)]


@query("mat_08", sql(f"{RETURNS}, dg AS (SELECT *, {DEGREES} FROM cr), final AS (SELECT *, {NORMED} FROM dg)", "ts", " ".join(ADJ_COLS)))
def _adjacency(t):
    return matrix.normalised_adjacency(correlations(t), SYMBOLS).select("ts", *ADJ_COLS)


INDICATORS = ["price", "volume", "ret", "swing"]


def indicator_rows(t):
    df = t.ticks().withColumn("swing", F.col("high") - F.col("low"))
    step = Step(lambda tl: tl.add({"ret": F.coalesce(F.ln(F.try_divide(F.col("price"), F.lag("price", 1).over(tl.over()))), F.lit(0.0))}), back=1)
    return on_series(df, step).select("symbol", "ts", "seq", *INDICATORS)


W60 = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
IND = f"""{TICKS}, i AS (SELECT symbol, ts, seq, price, volume, coalesce(ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS ret, high - low AS swing FROM ticks)"""
CELLS = [(a, b) for n, a in enumerate(INDICATORS) for b in INDICATORS[n + 1 :]]


@query(
    "mat_03",
    sql(
        f"{IND}, c AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn, {', '.join(f'corr({a}, {b}) {W60} AS {a}_{b}' for a, b in CELLS)} FROM i), final AS (SELECT * FROM c WHERE rn >= 60)",
        "symbol, seq",
        " ".join(f"{a}_{b}" for a, b in CELLS),
    ),
)
def _indicator_corr(t):
    out = matrix.map_correlations(indicator_rows(t), INDICATORS, 60)
    k = len(INDICATORS)
    cells = [F.get("corr", F.lit(INDICATORS.index(a) * k + INDICATORS.index(b))).alias(f"{a}_{b}") for a, b in CELLS]
    return out.select("symbol", "seq", *cells)


def corr_cell(a: str, b: str) -> str:
    return "1e0" if a == b else "_".join(sorted((a, b), key=INDICATORS.index))


SQUARE = ", ".join(f"{' + '.join(f'{corr_cell(a, c)} * {corr_cell(c, b)}' for c in INDICATORS)} AS sq_{a}_{b}" for a in INDICATORS for b in INDICATORS)
TRACES = {
    1: "4e0",
    2: " + ".join(f"sq_{a}_{a}" for a in INDICATORS),
    3: " + ".join(f"sq_{a}_{b} * {corr_cell(a, b)}" for a in INDICATORS for b in INDICATORS),
    4: " + ".join(f"sq_{a}_{b} * sq_{a}_{b}" for a in INDICATORS for b in INDICATORS),
}


@query(
    "mat_04",
    sql(
        f"{IND}, c AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn, {', '.join(f'corr({a}, {b}) {W60} AS {a}_{b}' for a, b in CELLS)} FROM i), sq AS (SELECT *, {SQUARE} FROM c WHERE rn >= 60), final AS (SELECT symbol, seq, true AS descending, {', '.join(f'{x} AS power_{k}' for k, x in TRACES.items())} FROM sq)",
        "symbol, seq, descending",
        "power_1 power_2 power_3 power_4",
    ),
)
def _eigenvalues(t):
    """All power sums up to the count of the eigenvalues, which fix them; they are the traces of the matrix powers."""
    out = matrix.map_correlations(indicator_rows(t), INDICATORS, 60, spectrum=True)
    e = [F.get("eigenvalues", F.lit(i)) for i in range(4)]
    powers = [sum((x**k for x in e[1:]), e[0] ** k).alias(f"power_{k}") for k in TRACES]
    return out.select("symbol", "seq", ((e[0] >= e[1]) & (e[1] >= e[2]) & (e[2] >= e[3])).alias("descending"), *powers)


def light_samples(t):
    """Spectral samples from the bounded-window indicators."""
    steps = [ind.sma("price", 14, "sma_14"), ind.bollinger(), ind.vwap(), ind.chaikin_flow(), ind.volume_z(), ind.simple_returns(), ind.momentum(), ind.tick_intensity()]
    names = ["sma_14", "bb_width", "bb_pct_b", "vwap_20", "cmf_20", "vol_z_20", "ret_1", "momentum_10", "tick_intensity"]
    frame = on_series(t.ticks(), steps).select("symbol", "ts", "seq", "price", *names).na.drop()
    return pipeline.spectral_samples(t.ticks(), indicators=frame, warm_up=8)


@query("mat_05")
def _spectral(t):
    return pipeline.spectral_table(light_samples(t), top_n=4).drop("ts")


@query(
    "mat_06",
    sql(
        f"{IND}, l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 60), final AS ("
        + " UNION ALL ".join(
            f"SELECT symbol, '{a}' AS row_name, '{b}' AS col_name, {'1e0' if a == b else f'corr({a}, {b})'} AS corr FROM l GROUP BY symbol" for a in INDICATORS for b in INDICATORS
        )
        + ")",
        "symbol, row_name, col_name",
        "corr",
    ),
)
def _latest(t):
    return matrix.latest_correlation(indicator_rows(t), INDICATORS, 60)


@query(
    "mat_11",
    sql(
        f"""{TICKS}, d AS (SELECT symbol, {', '.join(f'price - lag(price, {k}) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d{k}' for k in range(2, 20))} FROM ticks),
s AS (SELECT symbol, unnest([{', '.join(f'ln({k}e0)' for k in range(2, 20))}]) AS x, unnest([{', '.join(f'ln(sqrt(stddev_pop(d{k})))' for k in range(2, 20))}]) AS y FROM d GROUP BY symbol),
final AS (SELECT symbol, 2 * regr_slope(y, x) AS hurst FROM s GROUP BY symbol)""",
        "symbol",
        "hurst",
    ),
)
def _hurst(t):
    return matrix.hurst(t.ticks(), "price")


@query("udf_01", sql(f"{TICKS}, final AS (SELECT symbol, seq, CASE WHEN count(*) OVER w >= 8 THEN max(price) OVER w - min(price) OVER w END AS spread FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))", "symbol, seq", "spread"))
def _rolling(t):
    return on_series(t.ticks(), rolling_apply("price", 8, lambda w: w.max() - w.min(), "spread")).select("symbol", "seq", "spread")


# -- predictions -----------------------------------------------------------------------------------

PREDS = f"""{TICKS}, preds AS (SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS idx, seq, symbol AS model, (volume - 49) / 1e3 AS y_true,
  ((seq * 31) % 101 - 50) / 1e3 + (volume - 49) / 5e3 AS y_pred, (volume - 30) / 1e3 AS other FROM ticks),
pnl AS (SELECT *, sign(y_pred) * y_true AS gross, sign(y_pred) * y_true - abs(sign(y_pred)) * 5.5e0 / 1e4 AS pnl FROM preds)"""


def preds(t):
    df = folds.indexed(t.ticks())
    v = F.col("volume") - 49
    return df.select(
        "idx",
        "seq",
        F.col("symbol").alias("model"),
        (v / 1e3).alias("y_true"),
        (((F.col("seq") * 31) % 101 - 50) / 1e3 + v / 5e3).alias("y_pred"),
        ((F.col("volume") - 30) / 1e3).alias("other"),
    )


def keyed(t):
    """Predictions numbered within each model."""
    return folds.indexed(preds(t).drop("idx"), ("seq",), ("model",))


KEYED = f"{PREDS}, keyed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY model ORDER BY seq) - 1 AS idx) FROM preds)"
HIT = "CAST(sign(y_true) = sign(y_pred) AS INTEGER)"
ERRORS = f"avg(pow(y_true - y_pred, 2)) AS mse, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg({HIT}) AS directional_accuracy"


@query("evl_01", sql(f"{PREDS}, final AS (SELECT model, count(*) AS samples, {ERRORS} FROM preds GROUP BY model)", "model, samples", "mse mae rmse directional_accuracy"))
def _errors(t):
    return ev.errors(preds(t), ("model",))


ONE = "OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)"
CURVE = f"""cv0 AS (SELECT *, sum(pnl) {ONE} AS equity FROM pnl), cv AS (SELECT *, equity - max(equity) {ONE} AS drawdown FROM cv0)"""


@query("evl_02", sql(f"{PREDS}, {CURVE}, final AS (SELECT idx, gross AS gross_pnl, pnl, equity, drawdown FROM cv)", "idx", "gross_pnl pnl equity drawdown"))
def _pnl(t):
    return ev.curve(ev.trade(preds(t))).select("idx", "gross_pnl", "pnl", "equity", "drawdown")


@query(
    "evl_03",
    sql(
        f"""{PREDS}, d AS (SELECT idx // 375 AS d, sum(pnl) AS r FROM pnl GROUP BY 1),
final AS (SELECT 'rows' AS per, avg(pnl) / stddev_samp(pnl) * sqrt(252e0) AS sharpe_ratio FROM pnl UNION ALL SELECT 'days', avg(r) / stddev_samp(r) * sqrt(252e0) FROM d)""",
        "per",
        "sharpe_ratio",
    ),
)
def _sharpe(t):
    rows = ev.trade(preds(t))
    daily = ev.sharpe(rows, annual=94_500.0).select(F.lit("days").alias("per"), "sharpe_ratio")
    return ev.sharpe(rows).select(F.lit("rows").alias("per"), "sharpe_ratio").unionByName(daily)


SORTINO = "CASE WHEN count(*) FILTER (pnl < 0) < 2 THEN 0 ELSE avg(pnl) / (stddev_pop(pnl) FILTER (pnl < 0) + 1e-12) * sqrt(252e0) END"


@query("evl_04", sql(f"{PREDS}, final AS (SELECT model, {SORTINO} AS sortino_ratio FROM pnl GROUP BY model)", "model", "sortino_ratio"))
def _sortino(t):
    return ev.trade(preds(t)).groupBy("model").agg(ev.sortino_of().alias("sortino_ratio"))


CALMAR = "(arg_max(equity, idx) - arg_min(equity, idx)) / abs(min(drawdown))"


@query("evl_05", sql(f"{PREDS}, {CURVE}, final AS (SELECT 1 AS one, {CALMAR} AS calmar_ratio FROM cv)", "one", "calmar_ratio"))
def _calmar(t):
    return ev.curve(ev.trade(preds(t))).agg(F.lit(1).alias("one"), ev.calmar_of().alias("calmar_ratio"))


STATS = """count(*) FILTER (pnl > 0) / count(*) FILTER (pnl <> 0) AS win_rate, sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)) AS profit_factor,
  avg(pnl) FILTER (pnl <> 0) AS expectancy, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades"""


@query("evl_06", sql(f"{PREDS}, final AS (SELECT model, {STATS} FROM pnl GROUP BY model)", "model, total_trades, winning_trades, losing_trades", "win_rate profit_factor expectancy"))
def _stats(t):
    return ev.trade(preds(t)).groupBy("model").agg(*ev.trade_stats())


COMBOS = ", ".join(f"({c},{g},{str(a).lower()},{str(b).lower()})" for c, g, a, b in folds.combination_rows(16, 8, 200, 42))


def cpcv_sql(source: str, trim: int, key: str = "k") -> str:
    return f"""combos(combo, grp, cl, cr) AS (VALUES {COMBOS}),
tot AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
grp AS (SELECT *, ((idx + 1) * 16 - 1) // n AS grp FROM tot),
seg AS (SELECT *, (grp * n) // 16 AS a, ((grp + 1) * n) // 16 AS b FROM grp),
cmb AS (SELECT {key}, combo, count(*) AS test_rows, avg({HIT}) AS directional_accuracy, avg(sign(y_pred) * y_true) AS m, stddev_pop(sign(y_pred) * y_true) AS s
  FROM seg JOIN combos USING (grp) WHERE (NOT cl OR idx >= a + {trim}) AND (NOT cr OR idx < b - {trim}) GROUP BY {key}, combo HAVING count(*) >= 16),
cps AS (SELECT {key}, combo, test_rows, directional_accuracy, CASE WHEN s <= 1e-12 THEN 0 ELSE m / (s + 1e-12) * sqrt(252e0) END AS sharpe FROM cmb)"""


CPS = f"{PREDS}, one AS (SELECT *, 1 AS k FROM preds), {cpcv_sql('one', 45)}"
DIST = """dist AS (SELECT count(*) AS n_combinations_evaluated, avg(directional_accuracy) AS directional_accuracy_mean, stddev_pop(directional_accuracy) AS directional_accuracy_std,
  quantile_cont(directional_accuracy, 0.025) AS directional_accuracy_ci95_low, quantile_cont(directional_accuracy, 0.975) AS directional_accuracy_ci95_high,
  avg(sharpe) AS sharpe_mean, stddev_pop(sharpe) AS sharpe_std, quantile_cont(sharpe, 0.025) AS sharpe_ci95_low, quantile_cont(sharpe, 0.975) AS sharpe_ci95_high FROM cps)"""
# Normal distribution function: a power series near zero, a continued fraction in the tails.
SERIES = "0.5e0 + list_sum(list_transform(range(80), lambda k: pow(-1e0, k) * pow({0}, 2 * k + 1) / (pow(2e0, k) * gamma(k + 1e0) * (2 * k + 1)))) / sqrt(2 * pi())"
TAIL = "exp(-{0} * {0} / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(abs({0}), list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda a, k: abs({0}) + k / a)"
PHI = f"CASE WHEN {{0}} < -3 THEN {TAIL} WHEN {{0}} > 3 THEN 1 - {TAIL} ELSE {SERIES} END"

DIST_COLS = "directional_accuracy_mean directional_accuracy_std directional_accuracy_ci95_low directional_accuracy_ci95_high sharpe_mean sharpe_std sharpe_ci95_low sharpe_ci95_high"
REPORT = f"""rep AS (SELECT {ERRORS}, sum(pnl) AS total_pnl_proxy, sum(gross) AS gross_total_pnl_proxy, min(drawdown) AS max_drawdown_proxy, {STATS},
  avg(pnl) / stddev_samp(pnl) * sqrt(252e0) AS sharpe_ratio, {SORTINO} AS sortino_ratio, {CALMAR} AS calmar_ratio FROM cv),
stk AS (SELECT max(n) AS max_consecutive_losses FROM (SELECT count(*) FILTER (pnl < 0) AS n FROM (SELECT pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) {ONE} AS g FROM pnl) GROUP BY g))"""
REPORT_IDS = "total_trades, winning_trades, losing_trades, max_consecutive_losses, n_combinations_evaluated"
REPORT_COLS = (
    "mse mae rmse directional_accuracy total_pnl_proxy gross_total_pnl_proxy max_drawdown_proxy win_rate profit_factor expectancy sharpe_ratio sortino_ratio calmar_ratio "
    + DIST_COLS
    + " pbo_proxy commission_bps slippage_bps market_impact_bps"
)
COSTS = f"{ev.COMMISSION!r}::DOUBLE AS commission_bps, {ev.SLIPPAGE!r}::DOUBLE AS slippage_bps, {ev.IMPACT!r}::DOUBLE AS market_impact_bps"
PBO = f"pz AS (SELECT -sharpe_mean / sharpe_std AS z FROM dist), pb AS (SELECT {PHI.format('z')} AS pbo_proxy, {COSTS} FROM pz)"


@query("evl_07", sql(f"{CPS}, {DIST}, {PBO}, {CURVE}, {REPORT}, final AS (SELECT * FROM rep, stk, dist, pb)", REPORT_IDS, REPORT_COLS))
def _report(t):
    out = ev.backtest(preds(t)).select("*", "cpcv.*")
    return out.select(*[c.strip() for c in REPORT_IDS.split(",")], *REPORT_COLS.split())


@query("evl_08", sql(f"{CPS}, final AS (FROM cps)", "combo, test_rows", "directional_accuracy sharpe"))
def _cpcv(t):
    return ev.cpcv_combinations(preds(t)).select("combo", "test_rows", "directional_accuracy", "sharpe")


@query(
    "evl_09",
    sql(
        f"{KEYED}, {cpcv_sql('keyed', 45, 'model')}, z AS (SELECT model, avg(sharpe) AS m, -avg(sharpe) / stddev_pop(sharpe) AS z FROM cps GROUP BY model), final AS (SELECT model, m AS sharpe_mean, {PHI.format('z')} AS pbo_proxy FROM z)",
        "model",
        "sharpe_mean pbo_proxy",
    ),
)
def _pbo(t):
    return ev.cpcv(keyed(t), ("model",)).select("model", "sharpe_mean", "pbo_proxy")


PROBS = f"""{KEYED}, probs AS (SELECT model, idx, 1 / (1 + exp(-50 * y_pred)) AS prob, CASE WHEN y_true > 0 THEN 1 ELSE 0 END AS label, y_true / 10 AS ret FROM keyed),
lab AS (SELECT *, CASE WHEN prob >= 0.6 THEN 1 ELSE 0 END AS pred_label, CASE WHEN prob >= 0.6 THEN ret ELSE -ret END AS pnl FROM probs)"""


def probs(t):
    y, p = F.col("y_true"), F.col("y_pred")
    return keyed(t).select("model", "idx", (1.0 / (1.0 + F.exp(-50.0 * p))).alias("prob"), F.when(y > 0, 1).otherwise(0).alias("label"), (y / 10).alias("ret"))


GROWTH = "OVER (PARTITION BY model ORDER BY idx ROWS UNBOUNDED PRECEDING)"
WF = f"""gr AS (SELECT *, exp(sum(ln(1 + pnl)) {GROWTH}) AS g FROM lab), dd AS (SELECT model, max(dr) AS drawdown FROM (SELECT model, 1 - g / max(g) {GROWTH} AS dr FROM gr) GROUP BY model),
dy AS (SELECT model, idx // 375 AS d, sum(pnl) AS r FROM lab GROUP BY ALL), sh AS (SELECT model, coalesce(avg(r) / stddev_samp(r) * sqrt(252e0), 0) AS sharpe FROM dy GROUP BY model),
fm AS (SELECT model, avg(CAST(pred_label = label AS INTEGER)) AS dir_acc, avg(pow(label - prob, 2)) AS loss FROM lab GROUP BY model)"""


def listed_sql(c: str) -> str:
    """Values by fold as text of six digits."""
    return f"string_agg(CAST(CAST({c} + {NUDGE!r} AS DECIMAL(18, 6)) AS VARCHAR), ',' ORDER BY model)"


@query(
    "evl_10",
    sql(
        f"""{PROBS}, {WF}, final AS (SELECT quantile_cont(sharpe, 0.05) AS wf_sharpe_p5, avg(sharpe) AS wf_sharpe_mean, stddev_samp(sharpe) AS wf_sharpe_std, avg(dir_acc) AS wf_dir_acc_mean,
  avg(loss) AS wf_loss_mean, max(drawdown) AS wf_max_drawdown_ratio, count(*) AS wf_n_folds,
  {listed_sql('sharpe')} AS wf_fold_sharpes, {listed_sql('drawdown')} AS wf_fold_drawdowns FROM fm JOIN dd USING (model) JOIN sh USING (model))""",
        "wf_n_folds, wf_fold_sharpes, wf_fold_drawdowns",
        "wf_sharpe_p5 wf_sharpe_mean wf_sharpe_std wf_dir_acc_mean wf_loss_mean wf_max_drawdown_ratio",
    ),
)
def _summary(t):
    per = ev.fold_metrics(probs(t).withColumnRenamed("model", "fold"), 0.6)
    out = ev.walk_forward_summary(per)
    return out.withColumns({c: F.array_join(F.transform(c, lambda v: (v + NUDGE).cast("decimal(18,6)").cast("string")), ",") for c in ("wf_fold_sharpes", "wf_fold_drawdowns")})


@query(
    "evl_11",
    sql(
        f"""{PROBS}, final AS (SELECT model, count(*) AS val_samples, avg(pow(label - prob, 2)) AS val_mse, avg(abs(label - prob)) AS val_mae, sqrt(avg(pow(label - prob, 2))) AS val_rmse,
  avg(CAST(pred_label = label AS INTEGER)) AS val_directional_accuracy, avg(pnl) AS val_strategy_mean_return, stddev_samp(pnl) AS val_strategy_std_return,
  avg(label) AS val_positive_rate, avg(pred_label) AS val_pred_positive_rate FROM lab GROUP BY model)""",
        "model, val_samples",
        "val_mse val_mae val_rmse val_directional_accuracy val_strategy_mean_return val_strategy_std_return val_positive_rate val_pred_positive_rate",
    ),
)
def _threshold(t):
    return ev.classification(probs(t), ("model",), 0.6)


BLEND = """bw AS (SELECT var_pop(y_true - y_pred) AS va, var_pop(y_true - other) AS vb, covar_samp(y_true - y_pred, y_true - other) AS c, model FROM preds GROUP BY model),
wt AS (SELECT model, CASE WHEN va + vb - 2 * c < 1e-12 THEN 0.5e0 ELSE greatest(least((vb - c) / (va + vb - 2 * c), 1), 0) END AS wa FROM bw)"""


@query("evl_12", sql(f"{PREDS}, {BLEND}, final AS (SELECT model, wa AS weight_a, 1 - wa AS weight_b FROM wt)", "model", "weight_a weight_b"))
def _blend(t):
    return ev.blend_weights(preds(t), "y_pred", "other", ("model",))


@query(
    "evl_13",
    sql(
        f"""{KEYED}, tl AS (SELECT * FROM keyed QUALIFY idx >= count(*) OVER (PARTITION BY model) - 100),
hd AS (SELECT model, {', '.join(f'y_true - lag(y_true, {k}) OVER (PARTITION BY model ORDER BY idx) AS d{k}' for k in range(2, 20))} FROM tl),
hs AS (SELECT model, unnest([{', '.join(f'ln({k}e0)' for k in range(2, 20))}]) AS x, unnest([{', '.join(f'ln(sqrt(stddev_pop(d{k})))' for k in range(2, 20))}]) AS y FROM hd GROUP BY model),
h AS (SELECT model, 2 * regr_slope(y, x) AS hurst FROM hs GROUP BY model), {BLEND},
fw AS (SELECT model, wa, hurst, greatest(least(wa + (hurst - 0.5) * 2, 1), 0) AS fw FROM wt JOIN h USING (model)),
bl AS (SELECT *, y_pred * fw + other * (1 - fw) AS blended FROM preds JOIN fw USING (model)),
rp AS (SELECT model, any_value(wa) AS optimal_weight_a, any_value(hurst) AS hurst, any_value(fw) AS final_weight_a, avg(pow(y_true - blended, 2)) AS hybrid_mse,
  avg(abs(y_true - blended)) AS hybrid_mae, avg(CAST(sign(y_true) = sign(blended) AS INTEGER)) AS hybrid_directional_accuracy, avg(pow(y_true - y_pred, 2)) AS base_mse FROM bl GROUP BY model),
final AS (SELECT *, (base_mse - hybrid_mse) / (base_mse + 1e-12) * 100 AS residual_reduction_pct FROM rp)""",
        "model",
        "optimal_weight_a hurst final_weight_a hybrid_mse hybrid_mae hybrid_directional_accuracy base_mse residual_reduction_pct",
    ),
)
def _regime(t):
    return ev.regime_blend(keyed(t), "y_pred", "other", ("model",))[1]


@query("evl_14", sql(f"{PREDS}, final AS (SELECT idx, y_true - y_pred AS residual, y_pred + other AS hybrid FROM preds)", "idx", "residual hybrid"))
def _residuals(t):
    return ev.residuals(preds(t), "y_pred", "other").select("idx", "residual", "hybrid")


@query("evl_19", sql(f"{KEYED}, {cpcv_sql('keyed', 3, 'model')}, er AS (SELECT model, count(*) AS samples, {ERRORS}, avg(sign(y_pred) * y_true) / stddev_samp(sign(y_pred) * y_true) * sqrt(252e0) AS sharpe_ratio FROM keyed GROUP BY model), z AS (SELECT model, -avg(sharpe) / stddev_pop(sharpe) AS z FROM cps GROUP BY model), pb AS (SELECT model, {PHI.format('z')} AS pbo_proxy FROM z), final AS (SELECT er.*, pbo_proxy, model = first_value(model) OVER (ORDER BY pbo_proxy, model) AS lowest_pbo FROM er JOIN pb USING (model))", "model, samples, lowest_pbo", "mse mae rmse directional_accuracy sharpe_ratio pbo_proxy"))
def _models(t):
    return ev.compare_models(keyed(t))


@query(
    "evl_23",
    sql(
        f"{PREDS}, final AS (SELECT model, avg(CASE WHEN abs(y_true - y_pred) * 20 <= 1 THEN 0.5e0 * pow((y_true - y_pred) * 20, 2) ELSE abs(y_true - y_pred) * 20 - 0.5e0 END) + avg(greatest(-y_pred * y_true * 400, 0)) AS loss FROM preds GROUP BY model)",
        "model",
        "loss",
    ),
)
def _huber(t):
    df = preds(t).withColumns({"y_true": F.col("y_true") * 20, "y_pred": F.col("y_pred") * 20})
    return ev.directional_huber(df, ("model",))


@query(
    "evl_24",
    sql(
        f"""{PROBS}, pb AS (SELECT model, label, round(prob, 9) AS prob FROM probs),
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2e0 AS r FROM pb),
final AS (SELECT model, avg(-CASE WHEN label = 1 THEN ln(prob) ELSE ln(1 - prob) END) AS log_loss,
  (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))) AS auc FROM rk GROUP BY model)""",
        "model",
        "log_loss auc",
    ),
)
def _auc(t):
    return ev.log_loss_auc(probs(t).withColumn("prob", F.round("prob", 9)), ("model",))


@query("fun_11", sql("final AS (SELECT event_id, value * 252e0 AS yearly, value * sqrt(252e0 * 375) AS minute_vol, event_id // 375 AS day_no FROM events)", "event_id, day_no", "yearly minute_vol"))
def _annual(t):
    v, e = F.col("value"), F.col("event_id")
    return t.raw("events").select(
        "event_id", F.floor(e / int(94_500 / 252)).alias("day_no"), (v * 252.0).alias("yearly"), (v * F.sqrt(F.lit(252.0 * 375))).alias("minute_vol")
    )


@query("fun_12", sql(f"{PREDS}, z AS (SELECT model, -avg(y_true) / stddev_pop(y_true) AS z FROM preds GROUP BY model), final AS (SELECT model, {PHI.format('z')} AS below_zero, 0.6744897501960817e0 * 2 AS quartile_span FROM z)", "model", "below_zero quartile_span"))
def _cdf(t):
    from barloom.operators.options import Z75

    agg = preds(t).groupBy("model").agg((-F.avg("y_true") / F.stddev_pop("y_true")).alias("_z"))
    return agg.select("model", normal_cdf(F.col("_z")).alias("below_zero"), F.lit(Z75 * 2).alias("quartile_span"))


# -- trials ----------------------------------------------------------------------------------------

TRIALS = """trials AS (SELECT p_partkey AS trial_id, CASE p_partkey % 7 WHEN 5 THEN 'PRUNED' WHEN 6 THEN 'FAIL' ELSE 'COMPLETE' END AS state, p_size, p_retailprice, p_type,
  CASE WHEN p_partkey % 7 < 5 THEN (p_retailprice % 100) / 20e0 END AS score, (p_retailprice % 50) / 12e0 AS sharpe, (p_size % 10) / 10e0 AS pbo,
  48e-2 + (p_size % 8) / 1e2 AS accuracy, p_size / 1e2 AS drawdown, p_retailprice / 1e3 AS loss FROM part)"""


def trial_table(t):
    key, size, px = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    state = F.when(key % 7 == 5, "PRUNED").when(key % 7 == 6, "FAIL").otherwise("COMPLETE")
    return t.raw("part").select(
        key.alias("trial_id"),
        state.alias("state"),
        "p_size",
        "p_retailprice",
        "p_type",
        F.when(key % 7 < 5, (px % 100) / 20.0).alias("score"),
        ((px % 50) / 12.0).alias("sharpe"),
        ((size % 10) / 10.0).alias("pbo"),
        (0.48 + (size % 8) / 100.0).alias("accuracy"),
        (size / 100.0).alias("drawdown"),
        (px / 1000.0).alias("loss"),
    )


DEFLATED = """bf AS (SELECT *, sum(CASE WHEN state = 'COMPLETE' THEN 1 ELSE 0 END) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING) - CASE WHEN state = 'COMPLETE' THEN 1 ELSE 0 END AS completed_before FROM trials),
df AS (SELECT *, greatest(pbo - 0.2, 0) * 2 AS pbo_penalty, sharpe - greatest(pbo - 0.2e0, 0) * 2 AS effective_sharpe,
  sharpe * sqrt(greatest(1 - 0.5772e0 * (CASE WHEN completed_before > 0 THEN sqrt(2 * ln(completed_before)) ELSE 0 END / greatest(1, sharpe)), 0.01e0)) AS deflated_sharpe FROM bf)"""


@query("evl_15", sql(f"{TRIALS}, {DEFLATED}, final AS (SELECT trial_id, CAST(completed_before AS BIGINT) AS completed_before, pbo_penalty, effective_sharpe, deflated_sharpe FROM df)", "trial_id, completed_before", "pbo_penalty effective_sharpe deflated_sharpe"))
def _deflated(t):
    df = trials.effective_sharpe(trials.deflated_sharpe(trial_table(t)))
    return df.select("trial_id", "completed_before", "pbo_penalty", "effective_sharpe", "deflated_sharpe")


@query(
    "evl_16",
    sql(
        f"""{TRIALS}, {DEFLATED}, final AS (SELECT trial_id, deflated_sharpe >= 2 AND accuracy > 0.52e0 AS meets_target,
  deflated_sharpe + (accuracy - 0.5e0) * 8 - greatest(0.52e0 - accuracy, 0) * 30 - greatest(2 - deflated_sharpe, 0) * 3 AS score_max,
  loss + greatest(0.52e0 - accuracy, 0) * 12 + CASE WHEN deflated_sharpe < 2 THEN (2 - deflated_sharpe) * 0.3e0 ELSE -(least(deflated_sharpe, 3) - 2) * 0.1e0 END AS score_min
  FROM df WHERE drawdown <= 0.25)""",
        "trial_id, meets_target",
        "score_max score_min",
    ),
)
def _scores(t):
    df = trials.drawdown_guard(trials.deflated_sharpe(trial_table(t)))
    df = trials.loss_score(trials.shortfall_score(df, "deflated_sharpe"), "deflated_sharpe")
    return df.select("trial_id", "meets_target", "score_max", "score_min")


SPACE = [trials.Range("p_size", 1, 50, "int"), trials.Range("p_retailprice", 900.0, 2000.0, "log"), trials.Choice("p_type", ("ECONOMY", "STANDARD", "PROMO"))]
POSITIONS = """ps AS (SELECT *, (p_size - 1) / 49e0 AS a, (ln(p_retailprice) - ln(900e0)) / (ln(2000e0) - ln(900e0)) AS b,
  CASE p_type WHEN 'ECONOMY' THEN 0e0 WHEN 'STANDARD' THEN 0.5e0 WHEN 'PROMO' THEN 1e0 END AS c FROM trials)"""


@query(
    "evl_17",
    sql(
        f"""{TRIALS}, {POSITIONS}, me AS (SELECT a AS ma, b AS mb, c AS mc, score AS base, trial_id AS me FROM ps WHERE trial_id = 21),
ds AS (SELECT score, base, me, sqrt((pow(a - ma, 2) + pow(b - mb, 2) + coalesce(pow(c - mc, 2), 0)) / (2 + CASE WHEN c IS NOT NULL AND mc IS NOT NULL THEN 1 ELSE 0 END)) AS d
  FROM ps, me WHERE state = 'COMPLETE' AND trial_id <> me),
st AS (SELECT count(*) AS k, any_value(base) AS base, any_value(me) AS trial_id, median(score) AS local_median, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS local_iqr, max(score) AS local_best FROM ds WHERE d <= 0.3),
final AS (SELECT trial_id, k AS neighbor_count, 'ok' AS reason, local_median, local_iqr, local_best, least(k / 8e0, 1) AS coverage, greatest(base - local_median, 0) AS cliff_gap,
  (greatest(base - local_median, 0) * 0.35e0 + local_iqr * 0.1e0) * least(k / 8e0, 1) AS penalty FROM st)""",
        "trial_id, neighbor_count, reason",
        "local_median local_iqr local_best coverage cliff_gap penalty",
    ),
)
def _plateau(t):
    df = trial_table(t)
    return trials.plateau(df, df.where("trial_id = 21"), SPACE)


@query(
    "evl_18",
    sql(
        f"""{TRIALS}, final AS (SELECT count(*) AS n_trials_total, count(*) FILTER (state = 'COMPLETE') AS n_trials_complete, count(*) FILTER (state = 'PRUNED') AS n_trials_pruned,
  count(*) FILTER (state = 'FAIL') AS n_trials_failed, 0 AS n_trials_running, 0 AS n_trials_waiting, arg_max(trial_id, (score, -trial_id)) FILTER (state = 'COMPLETE') AS best_trial, max(score) AS best_score FROM trials)""",
        "n_trials_total, n_trials_complete, n_trials_pruned, n_trials_failed, n_trials_running, n_trials_waiting, best_trial",
        "best_score",
    ),
)
def _states(t):
    return trials.state_counts(trial_table(t))


@query(
    "top_06",
    sql(
        """imp AS (SELECT p_brand AS feature, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS importance FROM part GROUP BY p_brand),
final AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp QUALIFY rank <= 10)""",
        "feature, rank",
        "importance",
    ),
)
def _top(t):
    p = t.raw("part")
    total = p.agg(F.sum("p_retailprice").alias("_t"))
    imp = p.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("_s")).crossJoin(F.broadcast(total))
    return trials.top_importances(imp.select("feature", (F.col("_s") / F.col("_t")).alias("importance")))


# -- models ----------------------------------------------------------------------------------------

FEATURES = ["bb_pct_b", "vol_z_20", "momentum_10", "cmf_20"]


def model_frame(t):
    df = on_series(t.ticks(), [ind.bollinger(), ind.volume_z(), ind.momentum(), ind.chaikin_flow()])
    df = df.select("symbol", "ts", "seq", "price", *FEATURES).na.drop()
    ahead = Step(lambda tl: tl.add({"target": F.ln(F.try_divide(F.lead("price", 1).over(tl.over()), F.col("price")))}), ahead=1)
    df = on_series(df, ahead).where("target IS NOT NULL").withColumn("label", (F.col("target") > 0).cast("int"))
    return folds.indexed(df)


@query("evl_20")
def _direction(t):
    """Out-of-fold direction probabilities and what they earn, for all five folds."""
    df = model_frame(t)
    rows = durable(folds.assign(df, folds.anchored_ratio_table(folds.totals(df))))
    out = models.walk_forward_direction(rows, FEATURES, range(5))
    rows = folds.indexed(out.withColumn("ret", F.col("target") / 100).drop("idx"), ("ts", "seq"), ("fold",))
    return ev.fold_metrics(rows.select("fold", "idx", "prob", "label", "ret"))


def residual_model(t):
    """All rows, the first 80 % of them to train."""
    rows = folds.chronological(model_frame(t)).withColumn("first", F.col("bb_pct_b") - 0.5).withColumn("residual", F.col("target") - F.col("first"))
    rows = durable(rows)
    return rows, models.train_residual(rows, FEATURES)


@query("evl_21")
def _residual_trees(t):
    rows, model = residual_model(t)
    return trials.top_importances(models.importances(model, FEATURES, rows))


@query("evl_22")
def _scored(t):
    rows, model = residual_model(t)
    out = ev.scored(models.score(model, rows.where("role = 'val'"), base="first"))
    return out.select("symbol", "seq", "prediction", "target", "error", "abs_error")

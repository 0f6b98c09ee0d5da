"""Session features, targets, panels and equity curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.alignment import SYMBOLS
from barloom.catalog.base import BARS, PANEL_RETURNS, TICKS, query, scan, sql
from barloom.operators import session_features as sf
from barloom.operators.bars import resample
from barloom.plans.steps import on_series

S = sf.SESSION
SESS = "OVER (PARTITION BY symbol, session_date ORDER BY ts, seq)"
ALL = "OVER (PARTITION BY symbol ORDER BY ts, seq)"


def win(n: int) -> str:
    return f"OVER (PARTITION BY symbol, session_date ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RETURNS = f"{BARS}, ret AS (SELECT *, ln((close + 1e-8) / (lag(close) {SESS} + 1e-8)) AS log_ret, row_number() {SESS} - 1 AS rn FROM bars)"


def returns(t):
    return on_series(t.bars(), sf.log_return(), S)


def session(name, step, outs, ctes):
    @query(name, sql(f"{RETURNS}, {ctes}", "symbol, seq", outs))
    def _run(t):
        return on_series(returns(t), step(), S).select("symbol", "seq", *outs.split())


@query("win_30", sql(f"{RETURNS}, final AS (FROM ret)", "symbol, seq", "log_ret"))
def _returns(t):
    return returns(t).select("symbol", "seq", "log_ret")


@query(
    "win_31",
    sql(
        f"""{BARS}, ends AS (SELECT symbol, session_date, arg_min(close, (ts, seq)) AS f, arg_max(close, (ts, seq)) AS l FROM bars GROUP BY ALL),
n AS (SELECT symbol, session_date, ln((f + 1e-8) / (lag(l) OVER (PARTITION BY symbol ORDER BY session_date) + 1e-8)) AS overnight_ret FROM ends),
final AS (SELECT symbol, seq, overnight_ret FROM bars JOIN n USING (symbol, session_date))""",
        "symbol, seq",
        "overnight_ret",
    ),
)
def _overnight(t):
    return sf.overnight_return(t.bars()).select("symbol", "seq", "overnight_ret")


session(
    "win_32",
    sf.volume_zscore,
    "vol_zscore",
    f"""z AS (SELECT symbol, seq, CASE WHEN count(volume) {win(60)} >= 5 THEN (volume - avg(volume) {win(60)}) / greatest(stddev_samp(volume) {win(60)}, 1e-8) END AS z FROM ret),
final AS (SELECT symbol, seq, CASE WHEN z IS NOT NULL THEN greatest(least(z, 3.5e0), -3.5e0) END AS vol_zscore FROM z)""",
)


@query(
    "win_34",
    sql(
        f"""{RETURNS}, c AS (SELECT *, sum((high + low + close) / 3 * volume) {SESS} AS pv, sum(volume) {SESS} AS v,
  greatest(abs(high - low), abs(high - lag(close) {SESS}), abs(low - lag(close) {SESS})) AS tr FROM ret),
a AS {scan('c', 'tr', '$a * (1 - 1e0/14) + $x / 14', keys='symbol, session_date', name='atr')},
final AS (SELECT c.symbol, c.seq, (close - pv / greatest(v, 1)) / greatest(atr, 1e-8) AS vwap_dev FROM c JOIN a USING (symbol, session_date, seq))""",
        "symbol, seq",
        "vwap_dev",
    ),
)
def _vwap(t):
    return sf.vwap_deviation(t.bars()).select("symbol", "seq", "vwap_dev")


RV = "rv AS (SELECT *, coalesce(log_ret, 0) AS r FROM ret)"
RV5 = f"rv5 AS (SELECT *, sqrt(sum(r * r) {win(5)} * 94500) AS rv_5, sqrt(sum(r * r) {win(30)} * 94500) AS rv_30 FROM rv)"
session("win_35", sf.realised_vol, "rv_5 rv_30", f"{RV}, {RV5}, final AS (FROM rv5)")
session(
    "win_36",
    sf.vol_of_vol,
    "vov",
    f"{RV}, {RV5}, final AS (SELECT symbol, seq, CASE WHEN count(rv_5) {win(12)} >= 2 THEN stddev_samp(rv_5) {win(12)} END AS vov FROM rv5)",
)
@query(
    "win_37",
    sql(
        f"""{RETURNS}, {RV}, m AS (SELECT symbol, seq, sum(r) {win(5)} AS m_5, sum(r) {win(15)} AS m_15, sum(r) {win(30)} AS m_30 FROM rv),
d AS (SELECT *, (m_5 - m_15) / (abs(m_15) + 1e-8) AS raw FROM m), final AS (SELECT *, raw / (1 + abs(raw)) AS mds FROM d)""",
        "symbol, seq",
        "m_5 m_15 m_30 mds",
    ),
)
def _momentum(t):
    """The decay is squashed for the comparison: a middle sum of zero leaves only rounding in its divisor."""
    df = on_series(returns(t), sf.momentum_sums(), S)
    return df.select("symbol", "seq", "m_5", "m_15", "m_30", (F.col("mds") / (1 + F.abs("mds"))).alias("mds"))

ADR = "adr0 AS (SELECT ts, 1 AS k, count(*) FILTER (log_ret > 0) / 25e0 AS adv FROM panel_returns GROUP BY ts)"


@query(
    "win_38",
    sql(f"{PANEL_RETURNS}, {ADR}, final AS {scan('adr0', 'adv', '$a * (2e0/3) + $x / 3', keys='k', order='ts', name='adr', ident='ts')}", "ts", "adr"),
)
def _adr(t):
    adv = t.panel_returns().groupBy("ts").agg((F.count_if(F.col("log_ret") > 0) / 25.0).alias("adv"))
    return sf.ema_over_time(adv, {"adr": "adv"}).select("ts", "adr")


OI = "oi AS (SELECT l_shipdate AS ts, 1 AS k, sum(l_quantity) FILTER (l_linenumber % 2 = 0) AS call_oi, sum(l_quantity) FILTER (l_linenumber % 2 = 1) AS put_oi FROM lineitem GROUP BY l_shipdate)"


def oi_levels(t):
    side = F.col("l_linenumber") % 2
    return t.raw("lineitem").groupBy(F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.when(side == 0, F.col("l_quantity"))).alias("call_oi"), F.sum(F.when(side == 1, F.col("l_quantity"))).alias("put_oi")
    )


def ema5(x: str, out: str, source: str = "lv") -> str:
    """Span 5 with gaps: the mean is kept over a null while the weight of the past decays. A state is [mean, weight]."""
    return f"""(SELECT k, unnest(tss) AS ts, unnest(list_transform(ys, lambda s: s[1])) AS {out} FROM (SELECT k, list(ts ORDER BY ts) AS tss,
    list_reduce(list_transform(list({x} ORDER BY ts), lambda x: [[x, 1e0]]), lambda acc, v: list_append(acc,
      CASE WHEN v[1][1] IS NULL THEN [acc[-1][1], acc[-1][2] * (2e0/3)] WHEN acc[-1][1] IS NULL THEN [v[1][1], 1e0]
      ELSE [(acc[-1][2] * (2e0/3) * acc[-1][1] + v[1][1] / 3) / (acc[-1][2] * (2e0/3) + 1e0/3), 1e0] END)) AS ys FROM {source} GROUP BY k))"""


LEVELS = f"""{OI}, d AS (SELECT *, coalesce(call_oi - lag(call_oi) OVER (ORDER BY ts), 0) AS dc, coalesce(put_oi - lag(put_oi) OVER (ORDER BY ts), 0) AS dp
  FROM oi),
lv AS (SELECT ts, k, (call_oi - put_oi) / (call_oi + put_oi + 1) AS imb, (dc - dp) / (abs(dc) + abs(dp) + 1) AS flow, put_oi / (call_oi + 1) AS pcr FROM d)"""


@query("win_39", sql(f"{LEVELS}, final AS (SELECT ts, oi_imbalance, oi_flow FROM {ema5('imb', 'oi_imbalance')} JOIN {ema5('flow', 'oi_flow')} USING (k, ts))", "ts", "oi_imbalance oi_flow"))
def _oi(t):
    return sf.open_interest_flow(oi_levels(t)).select("ts", "oi_imbalance", "oi_flow")


@query("win_40", sql(f"{LEVELS}, final AS (SELECT ts, oi_imbalance, lv.pcr AS total_pcr_oi FROM {ema5('imb', 'oi_imbalance')} JOIN lv USING (k, ts))", "ts", "oi_imbalance total_pcr_oi"))
def _oi_pre(t):
    c, p = F.col("call_oi"), F.col("put_oi")
    pre = oi_levels(t).select("ts", ((c - p) / (c + p + 1.0)).alias("imb"), (p / (c + 1.0)).alias("total_pcr_oi"))
    return sf.ema_over_time(pre, {"oi_imbalance": "imb"}).select("ts", "oi_imbalance", "total_pcr_oi")


@query("win_41", sql(f"{RETURNS}, {RV}, {RV5}, final AS (SELECT symbol, seq, volume / 100 - rv_30 AS vrp FROM rv5)", "symbol, seq", "vrp"))
def _premium(t):
    df = on_series(returns(t), sf.realised_vol(), S).withColumn("atm_iv", F.col("volume") / 100)
    return df.select("symbol", "seq", sf.premium().alias("vrp"))


TARGET = f"tg AS (SELECT *, CASE WHEN lead(1) {SESS} IS NOT NULL THEN CAST(coalesce(lead(log_ret) {SESS} > 0, false) AS INTEGER) END AS target FROM ret)"


@query("win_42", f"WITH {RETURNS}, {TARGET} SELECT symbol, seq, target FROM tg")
def _target(t):
    return on_series(returns(t), sf.direction_target(), S).select("symbol", "seq", "target")


@query("win_43", f"WITH {RETURNS}, {TARGET} SELECT symbol, seq, target FROM tg WHERE target IS NOT NULL")
def _last_bar(t):
    return sf.drop_last_bar(on_series(returns(t), sf.direction_target(), S)).select("symbol", "seq", "target")


NEXT = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query(
    "win_44",
    sql(
        f"""{TICKS}, final AS (SELECT symbol, seq, CASE WHEN count(price) {NEXT} = 5 THEN
  (max(price) {NEXT} - min(price) {NEXT}) * sign(avg(price) {NEXT} - price) / greatest(abs(price), 1e-8) END AS target FROM ticks)""",
        "symbol, seq",
        "target",
    ),
)
def _range_target(t):
    return on_series(t.ticks(), sf.signed_range_target(5)).select("symbol", "seq", "target")


Z = f"""zz AS (SELECT symbol, seq, log_ret, CASE WHEN count(log_ret) {win(60)} >= 20 THEN avg(log_ret) {win(60)} WHEN count(log_ret) {SESS} >= 2 THEN avg(log_ret) {SESS} END AS mu,
  CASE WHEN count(log_ret) {win(60)} >= 20 THEN stddev_samp(log_ret) {win(60)} WHEN count(log_ret) {SESS} >= 2 THEN stddev_samp(log_ret) {SESS} END AS sd FROM ret),
final AS (SELECT symbol, seq, mu AS log_ret_mu, CASE WHEN sd IS NOT NULL THEN greatest(sd, 1e-6) END AS log_ret_std,
  CASE WHEN log_ret IS NOT NULL AND sd IS NOT NULL THEN greatest(least((log_ret - mu) / greatest(sd, 1e-6), 3.5e0), -3.5e0) END AS log_ret_z FROM zz)"""


@query("win_45", sql(f"{RETURNS}, {Z}", "symbol, seq", "log_ret_z"))
def _zscore(t):
    return sf.session_zscore(returns(t), ["log_ret"]).select("symbol", "seq", "log_ret_z")


@query("win_46", sql(f"{RETURNS}, {Z}", "symbol, seq", "log_ret_mu log_ret_std"))
def _zstats(t):
    return sf.session_zscore(returns(t), ["log_ret"], stats=True).select("symbol", "seq", "log_ret_mu", "log_ret_std")


NAMES = ", ".join(f"'{s}'" for s in SYMBOLS)
FILLED = f"""{TICKS}, px AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts)),
grid AS (SELECT ts, symbol FROM (SELECT DISTINCT ts FROM px), (SELECT unnest([{NAMES}]) AS symbol)),
filled AS (SELECT ts, symbol, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
  first_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM grid LEFT JOIN px USING (ts, symbol))"""


def filled(t):
    return sf.fill_panel(resample(t.ticks(), "1 hour").select("ts", "symbol", "price"), SYMBOLS)


@query(
    "win_47",
    sql(
        f"""{FILLED}, r AS (SELECT ts, symbol, ln(price / greatest(lag(price) OVER (PARTITION BY symbol ORDER BY ts), 1e-8)) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM filled),
final AS (SELECT ts, symbol, ret FROM r WHERE n > 1)""",
        "ts, symbol",
        "ret",
    ),
)
def _panel_returns(t):
    return sf.panel_returns(filled(t)).select("ts", "symbol", "ret")


INDEX = "ix AS (SELECT ts, ln(avg(price)) AS li, row_number() OVER (ORDER BY ts) - 1 AS row_no FROM filled GROUP BY ts)"


@query(
    "win_48",
    sql(
        f"{FILLED}, {INDEX}, final AS (SELECT ts, row_no, coalesce(lead(li, 3) OVER (ORDER BY ts), (SELECT arg_max(li, ts) FROM ix)) - li AS target FROM ix QUALIFY row_no > 0)",
        "ts, row_no",
        "target",
    ),
)
def _index_target(t):
    return sf.forward_index_return(filled(t), 3).select("ts", "row_no", "target")


@query("mat_02", f"WITH {FILLED}, {INDEX} SELECT row_no - 1 AS end_index FROM ix WHERE row_no - 1 BETWEEN 29 AND (SELECT count(*) FROM ix) - 2 - 3")
def _ends(t):
    from barloom.operators.matrix import sample_ends

    index = sf.forward_index_return(filled(t), 3).select((F.col("row_no") - 1).alias("end_index"))
    return sample_ends(index, seq_len=30, corr_window=20, horizon=3)


PNL = "pnl AS (SELECT seq AS idx, symbol, (volume - 49) / 1000 AS pnl FROM ticks)"


def pnl(t):
    return t.ticks().select(F.col("seq").alias("idx"), "symbol", ((F.col("volume") - 49) / 1000).alias("pnl"))


RUN = "OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)"


@query(
    "win_49",
    sql(
        f"""{TICKS}, {PNL}, e AS (SELECT *, sum(pnl) {RUN} AS equity, exp(sum(ln(1 + pnl)) {RUN}) AS growth FROM pnl),
p AS (SELECT *, max(equity) {RUN} AS peak, max(growth) {RUN} AS gp FROM e),
final AS (SELECT symbol, idx, equity, equity - peak AS drawdown, 1 - growth / gp AS drawdown_ratio FROM p)""",
        "symbol, idx",
        "equity drawdown drawdown_ratio",
    ),
)
def _drawdown(t):
    return sf.drawdowns(pnl(t), keys=("symbol",)).select("symbol", "idx", "equity", "drawdown", "drawdown_ratio")


@query(
    "win_50",
    f"""WITH {TICKS}, {PNL}, g AS (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM pnl),
r AS (SELECT grp, count(*) FILTER (pnl < 0) AS n FROM g GROUP BY grp) SELECT max(n) AS longest_losing_run FROM r""",
)
def _streak(t):
    return sf.losing_runs(pnl(t)).agg(F.max("losing_run").alias("longest_losing_run"))


@query(
    "win_51",
    sql(
        f"""{TICKS}, h AS (SELECT symbol, price, volume, lag(price) {ALL} AS b FROM ticks),
final AS (SELECT symbol, avg(CAST(sign(price - b) = sign(volume - b) AS INTEGER)) AS accuracy, count(b) AS n FROM h GROUP BY symbol)""",
        "symbol, n",
        "accuracy",
    ),
)
def _previous(t):
    hits = sf.previous_value_hits(t.ticks(), "price", "volume", ("symbol",), ("ts", "seq"))
    return hits.groupBy("symbol").agg(F.avg("hit").alias("accuracy"), F.count("hit").alias("n"))

"""Technical indicator queries over the tick table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import ORACLES, TICKS, query, scan, sql
from barloom.operators import indicators as ind
from barloom.plans.steps import on_series

IDS = "symbol, seq"


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n} THEN {agg}({x}) OVER {w(n)} END"


LAG = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
RN = f"row_number() {LAG} - 1"


def ewm_sql(source: str, x: str, alpha: str, out: str, need: int, start: int = 0) -> str:
    """Exponential mean of ``x`` from row ``start`` on; ``source`` must carry rn."""
    rows = f"(SELECT * FROM {source} WHERE rn >= {start})"
    return (
        f"(SELECT symbol, seq, CASE WHEN rn >= {start + need - 1} THEN y END AS {out} FROM "
        f"{scan(rows, x, f'$a * (1e0 - {alpha}) + {alpha} * $x')} JOIN (SELECT symbol, seq, rn FROM {source}) USING (symbol, seq))"
    )


def spark(t, steps, *names):
    return on_series(t.ticks(), steps).select("symbol", "seq", *names)


def register(name, steps, outs, ctes):
    @query(name, sql(f"{TICKS}, {ctes}", IDS, outs))
    def _run(t):
        return spark(t, steps(), *outs.split())


register(
    "win_01",
    lambda: [ind.sma("price", 14, "sma_14"), ind.sma("price", 50, "sma_50")],
    "sma_14 sma_50",
    f"final AS (SELECT symbol, seq, {full('avg', 'price', 14)} AS sma_14, {full('avg', 'price', 50)} AS sma_50 FROM ticks)",
)

T1 = f"t1 AS (SELECT *, {RN} AS rn FROM ticks)"
register(
    "win_02",
    lambda: [ind.ema("price", 12, "ema_12"), ind.ema("price", 26, "ema_26")],
    "ema_12 ema_26",
    f"{T1}, final AS (SELECT symbol, seq, ema_12, ema_26 FROM {ewm_sql('t1', 'price', '(2e0/13)', 'ema_12', 12)} "
    f"JOIN {ewm_sql('t1', 'price', '(2e0/27)', 'ema_26', 26)} USING (symbol, seq))",
)

RSI = f"""{T1}, mv AS (SELECT *, price - lag(price) {LAG} AS mv FROM t1),
gl AS (SELECT *, greatest(mv, 0e0) AS gain, greatest(-mv, 0e0) AS loss FROM mv),
rsi AS (SELECT t1.symbol, t1.seq, t1.ts, 100 - 100 / (1 + g / (l + 1e-12)) AS rsi_14 FROM t1
  LEFT JOIN {ewm_sql('gl', 'gain', '(1e0/14)', 'g', 14, 1)} a ON a.symbol = t1.symbol AND a.seq = t1.seq
  LEFT JOIN {ewm_sql('gl', 'loss', '(1e0/14)', 'l', 14, 1)} b ON b.symbol = t1.symbol AND b.seq = t1.seq)"""
register("win_03", lambda: [ind.rsi("price", 14, "rsi_14")], "rsi_14", f"{RSI}, final AS (FROM rsi)")

register(
    "win_04",
    lambda: [ind.macd()],
    "macd macd_signal macd_hist",
    f"""{T1}, ln AS (SELECT symbol, seq, ts, rn, f - s AS macd FROM t1
  JOIN {ewm_sql('t1', 'price', '(2e0/13)', 'f', 12)} USING (symbol, seq)
  JOIN {ewm_sql('t1', 'price', '(2e0/27)', 's', 26)} USING (symbol, seq)),
final AS (SELECT ln.symbol, ln.seq, macd, g AS macd_signal, macd - g AS macd_hist FROM ln
  LEFT JOIN {ewm_sql('ln', 'macd', '(2e0/10)', 'g', 9, 25)} x ON x.symbol = ln.symbol AND x.seq = ln.seq)""",
)

TR = f"""{T1}, tr AS (SELECT *, greatest(abs(high - low), abs(high - lag(price) {LAG}), abs(low - lag(price) {LAG})) AS tr FROM t1)"""
register(
    "win_05",
    lambda: [ind.atr(14, "atr_14")],
    "atr_14",
    f"{TR}, final AS (FROM {ewm_sql('tr', 'tr', '(1e0/14)', 'atr_14', 14)})",
)

register(
    "win_06",
    lambda: [ind.bollinger()],
    "bb_mid bb_upper bb_lower bb_width bb_pct_b",
    f"""m AS (SELECT symbol, seq, price, {full('avg', 'price', 20)} AS bb_mid, {full('stddev_samp', 'price', 20)} AS sd FROM ticks),
b AS (SELECT *, bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower FROM m),
final AS (SELECT *, (bb_upper - bb_lower) / (bb_mid + 1e-12) AS bb_width,
  (price - bb_lower) / (bb_upper - bb_lower + 1e-12) AS bb_pct_b FROM b)""",
)

register(
    "win_07",
    lambda: [ind.stoch_rsi()],
    "stoch_rsi stoch_rsi_k stoch_rsi_d",
    f"""{RSI}, s AS (SELECT *, (rsi_14 - {full('min', 'rsi_14', 14)}) / ({full('max', 'rsi_14', 14)} - {full('min', 'rsi_14', 14)} + 1e-12) AS stoch_rsi FROM rsi),
k AS (SELECT *, {full('avg', 'stoch_rsi', 3)} AS stoch_rsi_k FROM s),
final AS (SELECT *, {full('avg', 'stoch_rsi_k', 3)} AS stoch_rsi_d FROM k)""",
)

register(
    "win_08",
    lambda: [ind.vwap()],
    "vwap_20",
    f"""tp AS (SELECT *, (high + low + price) / 3 * volume AS tpv FROM ticks),
final AS (SELECT symbol, seq, {full('sum', 'tpv', 20)} / ({full('sum', 'volume', 20)} + 1e-12) AS vwap_20 FROM tp)""",
)

SIGNED = f"sv AS (SELECT *, sign(price - lag(price) {LAG}) * volume AS sv FROM ticks)"


@query(
    "win_09",
    sql(
        f"{TICKS}, {SIGNED}, final AS (SELECT symbol, seq, sum(sv) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS obv FROM sv)",
        IDS,
        "obv",
    ),
)
def _obv(t):
    return ind.on_balance_volume(t.ticks()).select("symbol", "seq", "obv")


register(
    "win_10",
    lambda: [ind.obv_momentum()],
    "obv",
    f"""{SIGNED}, o AS (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS c FROM sv),
final AS (SELECT symbol, seq, c - lag(c, 20) {LAG} AS obv FROM o)""",
)

register(
    "win_11",
    lambda: [ind.chaikin_flow()],
    "cmf_20",
    f"""f AS (SELECT *, ((price - low) - (high - price)) / (high - low + 1e-12) * volume AS mfv FROM ticks),
final AS (SELECT symbol, seq, {full('sum', 'mfv', 20)} / ({full('sum', 'volume', 20)} + 1e-12) AS cmf_20 FROM f)""",
)


def adjusted(source: str, x: str, out: str, start: int) -> str:
    """Bias-corrected exponential mean, alpha 1/14, needing 14 rows from ``start``."""
    rows = f"(SELECT * FROM {source} WHERE rn >= {start})"
    q = "(1e0 - 1e0/14)"
    return (
        f"(SELECT symbol, seq, CASE WHEN rn >= {start + 13} THEN y / ((1 - pow({q}, rn - {start} + 1)) / (1 - {q})) END AS {out} FROM "
        f"{scan(rows, x, f'$a * {q} + $x')} JOIN (SELECT symbol, seq, rn FROM {source}) USING (symbol, seq))"
    )


register(
    "win_12",
    lambda: [ind.adx()],
    "adx plus_di minus_di",
    f"""{TR}, mv AS (SELECT *, high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS dn FROM tr),
dm AS (SELECT *, CASE WHEN up > dn THEN greatest(up, 0e0) ELSE 0e0 END AS p, CASE WHEN dn > up THEN greatest(dn, 0e0) ELSE 0e0 END AS m FROM mv),
di AS (SELECT dm.symbol, dm.seq, dm.ts, dm.rn, 100 * pa / (atr + 1e-12) AS plus_di, 100 * ma / (atr + 1e-12) AS minus_di FROM dm
  JOIN {adjusted('dm', 'p', 'pa', 0)} USING (symbol, seq) JOIN {adjusted('dm', 'm', 'ma', 0)} USING (symbol, seq)
  JOIN {ewm_sql('dm', 'tr', '(1e0/14)', 'atr', 14)} USING (symbol, seq)),
dx AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-12) AS dx FROM di),
final AS (SELECT dx.symbol, dx.seq, adx, plus_di, minus_di FROM dx
  LEFT JOIN {adjusted('dx', 'dx', 'adx', 13)} a ON a.symbol = dx.symbol AND a.seq = dx.seq)""",
)

register(
    "win_13",
    lambda: [ind.keltner()],
    "kc_upper kc_mid kc_lower",
    f"""{TR}, final AS (SELECT symbol, seq, mid AS kc_mid, mid + 1.5e0 * a AS kc_upper, mid - 1.5e0 * a AS kc_lower
  FROM {ewm_sql('t1', 'price', '(2e0/21)', 'mid', 20)} JOIN {ewm_sql('tr', 'tr', '(1e0/14)', 'a', 14)} USING (symbol, seq))""",
)

register(
    "win_14",
    lambda: [ind.parkinson()],
    "parkinson_vol",
    f"""h AS (SELECT *, pow(ln(high / (low + 1e-12)), 2) AS hl FROM ticks),
final AS (SELECT symbol, seq, sqrt(({full('avg', 'hl', 20)}) / (4 * ln(2e0))) AS parkinson_vol FROM h)""",
)

register(
    "win_15",
    lambda: [ind.momentum()],
    "momentum_10 momentum_30",
    f"""final AS (SELECT symbol, seq,
  (price - lag(price, 10) {LAG}) / (lag(price, 10) {LAG} + 1e-12) * 100 AS momentum_10,
  (price - lag(price, 30) {LAG}) / (lag(price, 30) {LAG} + 1e-12) * 100 AS momentum_30 FROM ticks)""",
)

register(
    "win_16",
    lambda: [ind.tick_intensity()],
    "tick_intensity",
    f"""d AS (SELECT *, volume - lag(volume) {LAG} AS dv FROM ticks),
final AS (SELECT symbol, seq, {full('avg', 'dv', 20)} AS tick_intensity FROM d)""",
)

register(
    "win_17",
    lambda: [ind.simple_returns()],
    "ret_1 ret_5 ret_20",
    "final AS (SELECT symbol, seq, "
    + ", ".join(f"price / lag(price, {n}) {LAG} - 1 AS ret_{n}" for n in (1, 5, 20))
    + " FROM ticks)",
)

register(
    "win_18",
    lambda: [ind.mean_ratio()],
    "price_sma_ratio",
    f"final AS (SELECT symbol, seq, price / (({full('avg', 'price', 50)}) + 1e-12) AS price_sma_ratio FROM ticks)",
)

register(
    "win_19",
    lambda: [ind.volume_z()],
    "vol_z_20",
    f"final AS (SELECT symbol, seq, (volume - ({full('avg', 'volume', 20)})) / (({full('stddev_samp', 'volume', 20)}) + 1e-12) AS vol_z_20 FROM ticks)",
)

KALMAN = """k AS (SELECT symbol, unnest(ids) AS seq, unnest(list_transform(ys, lambda s: s[1])) AS kalman_price FROM (
  SELECT symbol, list(seq ORDER BY ts, seq) AS ids,
    list_reduce(list_transform(list(price ORDER BY ts, seq), lambda x: [[x, 1e0]]),
      lambda acc, v: list_append(acc, [
        acc[-1][1] + (acc[-1][2] + 1e-4) / (acc[-1][2] + 1e-4 + 1e-2) * (v[1][1] - acc[-1][1]),
        (1 - (acc[-1][2] + 1e-4) / (acc[-1][2] + 1e-4 + 1e-2)) * (acc[-1][2] + 1e-4)])) AS ys
  FROM ticks GROUP BY symbol))"""
register(
    "win_20",
    lambda: [ind.kalman()],
    "kalman_price price_kalman_ratio",
    f"""{KALMAN},
final AS (SELECT k.symbol, k.seq, kalman_price, price / (kalman_price + 1e-12) AS price_kalman_ratio
  FROM k JOIN ticks USING (symbol, seq))""",
)

register(
    "win_21",
    lambda: [ind.entropy()],
    "entropy_20",
    f"""l AS (SELECT *, ln(price / lag(price) {LAG}) AS lr FROM ticks),
bag AS (SELECT symbol, seq, list(lr) OVER {w(20)} AS v, count(lr) OVER {w(20)} AS n FROM l),
hist AS (SELECT symbol, seq, n, (list_max(v) - list_min(v)) / 10 AS width,
  list_transform(v, lambda e: least(floor((e - list_min(v)) / ((list_max(v) - list_min(v)) / 10)), 9)) AS slots FROM bag WHERE n = 20),
dens AS (SELECT symbol, seq, list_transform(range(10), lambda b: len(list_filter(slots, lambda s: s = b)) / (20 * width)) AS d FROM hist),
final AS (SELECT ticks.symbol, ticks.seq, -list_sum(list_transform(list_filter(d, lambda p: p > 0), lambda p: p * log2(p))) AS entropy_20
  FROM ticks LEFT JOIN dens ON dens.symbol = ticks.symbol AND dens.seq = ticks.seq)""",
)


register(
    "win_23",
    lambda: [ind.lags(["price", "volume"], [1, 2, 3])],
    "price_lag_1 price_lag_2 price_lag_3 volume_lag_1 volume_lag_2 volume_lag_3",
    "final AS (SELECT symbol, seq, "
    + ", ".join(f"lag({x}, {n}) {LAG} AS {x}_lag_{n}" for x in ("price", "volume") for n in (1, 2, 3))
    + " FROM ticks)",
)

register(
    "win_24",
    lambda: [ind.rolling_stats(["price", "volume"], [5, 10])],
    " ".join(f"{x}_{k}_{n}" for x in ("price", "volume") for n in (5, 10) for k in ("mean", "std")),
    "final AS (SELECT symbol, seq, "
    + ", ".join(
        f"{full(a, x, n)} AS {x}_{k}_{n}"
        for x in ("price", "volume")
        for n in (5, 10)
        for k, a in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + " FROM ticks)",
)

register(
    "win_25",
    lambda: [ind.warm_mean("price", 10, "synthetic_index")],
    "synthetic_index",
    f"final AS (SELECT symbol, seq, coalesce({full('avg', 'price', 10)}, price) AS synthetic_index FROM ticks)",
)


# The whole frame is the join of the single indicators, without the rows that lack one of them.
PARTS = [f"win_{i:02d}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21)]
FRAME = (
    f"SELECT * FROM ({sql(TICKS, IDS, 'price high low volume', 'ticks')}) p0 "
    + " ".join(f"JOIN ({ORACLES[n]}) USING (symbol, seq)" for n in PARTS)
)
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ind.feature_names())


@query("win_22", f"SELECT symbol, seq, {', '.join(ind.feature_names())} FROM ({FRAME}) WHERE {COMPLETE}")
def _all(t):
    return ind.with_indicators(t.ticks()).drop("ts")


@query(
    "prj_14",
    sql(
        "final AS (SELECT CAST(generate_subscripts(names, 1) AS BIGINT) AS position, unnest(names) AS feature, "
        "(SELECT count(*) FROM events) > 0 AS present FROM (SELECT "
        + str(ind.feature_names())
        + " AS names))",
        "position, feature, present",
    ),
)
def _schema(t):
    """The feature frame's columns against the contract."""
    have = [c for c in ind.with_indicators(t.ticks(), drop_incomplete=False).columns if c not in ("symbol", "ts", "seq")]
    names = t.raw("events").agg(F.array(*[F.lit(c) for c in have]).alias("names"), (F.count(F.lit(1)) > 0).alias("present"))
    return names.select(F.posexplode("names").alias("p", "feature"), "present").select(
        (F.col("p") + 1).cast("long").alias("position"), "feature", "present"
    )

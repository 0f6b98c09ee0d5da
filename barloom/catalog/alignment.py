"""Clock, as-of, range-join and dimension queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog.base import BARS, PANEL, TICKS, query, sql
from barloom.operators import align
from barloom.operators.bars import resample
from barloom.plans.steps import on_series

SYMBOLS = ["click", "error", "purchase", "signup", "view"]

SESSIONS = "sessions AS (SELECT DISTINCT symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS session_date FROM ticks)"
CLOCK = f"""{BARS}, {SESSIONS}, clock AS (SELECT symbol, session_date,
  CAST(session_date AS TIMESTAMP) + INTERVAL 225 MINUTE + to_minutes(i) AS ts FROM sessions, range(375) r(i))"""


def clock(t) -> DataFrame:
    days = t.ticks().select("symbol", align.local_day().alias("session_date")).distinct()
    return align.session_clock(days)


def asof_sql(tolerance: str) -> str:
    cols = ", ".join(f"CASE WHEN b.ts >= c.ts - INTERVAL {tolerance} THEN b.{x} END AS {x}" for x in ("open", "high", "low", "close", "volume"))
    return f"""{CLOCK}, joined AS (SELECT c.symbol, c.session_date, c.ts, CASE WHEN b.ts >= c.ts - INTERVAL {tolerance} THEN b.ts END AS matched_ts, {cols}
  FROM clock c ASOF LEFT JOIN bars b ON c.symbol = b.symbol AND c.ts >= b.ts)"""


@query("jon_01", f"WITH {CLOCK} SELECT symbol, session_date, ts FROM clock")
def _clock(t):
    return clock(t).select("symbol", "session_date", "ts")


@query("jon_02", sql(f"{asof_sql('60 SECOND')}, final AS (FROM joined)", "symbol, session_date, ts, matched_ts", "close volume"))
def _asof(t):
    hit = align.asof_join(clock(t), t.bars().drop("session_date"), ["close", "volume"], tolerance="60 SECONDS")
    return hit.select("symbol", "session_date", "ts", "matched_ts", "close", "volume")


@query(
    "jon_03",
    sql(
        f"""{asof_sql('900 SECOND')}, filled AS (SELECT symbol, ts, open AS o, volume AS v,
  last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM joined),
final AS (SELECT symbol, ts, coalesce(o, close) AS open, close, coalesce(v, 0) AS volume FROM filled)""",
        "symbol, ts",
        "open close volume",
    ),
)
def _fill(t):
    out = align.align_to_clock(clock(t), t.bars().drop("session_date"), "900 SECONDS")
    return out.select("symbol", "ts", "open", "close", "volume")


HOURLY = """hourly AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_max(price, (ts, seq)) AS price,
  sum(volume) AS volume FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts))"""
WIDE = [f"{s}_{c}" for s in SYMBOLS for c in ("price", "volume")]


@query(
    "jon_04",
    sql(
        f"{TICKS}, {HOURLY}, final AS (SELECT ts, "
        + ", ".join(f"max({c}) FILTER (symbol = '{s}') AS {s}_{c}" for s in SYMBOLS for c in ("price", "volume"))
        + " FROM hourly GROUP BY ts)",
        "ts",
        " ".join(WIDE),
    ),
)
def _wide(t):
    return align.to_wide(resample(t.ticks(), "1 hour"), SYMBOLS, ["price", "volume"]).select("ts", *WIDE)


REGIME_ROWS = "(DATE '1996-01-01', DATE '1998-06-30', 4, 0), (DATE '1998-04-01', DATE '2000-12-31', 1, 1), (DATE '2001-02-01', DATE '2001-12-31', 2, 2)"
REGIMES = f"regimes(date_from, date_to, expiry_weekday, regime_flag) AS (VALUES {REGIME_ROWS})"
TRADES = "trades AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS session_date FROM orders)"
DAY_REGIME = """day_regime AS (SELECT d.session_date, coalesce(arg_min(r.expiry_weekday, r.date_from), 3) AS expiry_weekday,
  coalesce(arg_min(r.regime_flag, r.date_from), 0) AS regime_flag FROM (SELECT DISTINCT session_date FROM trades) d
  LEFT JOIN regimes r ON d.session_date BETWEEN r.date_from AND r.date_to GROUP BY d.session_date)"""
OPEN_DAYS = "open_days AS (SELECT DISTINCT session_date FROM trades WHERE isodow(session_date) <= 5 AND day(session_date) % 9 <> 0)"
EXPIRY = """expiry AS (SELECT r.session_date, r.expiry_weekday, r.regime_flag, min(o.session_date) AS expiry_date FROM day_regime r LEFT JOIN open_days o
  ON o.session_date BETWEEN r.session_date AND r.session_date + 20 AND isodow(o.session_date) - 1 = r.expiry_weekday GROUP BY ALL)"""


def regimes(t) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM VALUES {REGIME_ROWS} AS v(date_from, date_to, expiry_weekday, regime_flag)")


def trades(t) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("session_date"))


def open_days(t) -> DataFrame:
    return trades(t).where("weekday(session_date) < 5 AND day(session_date) % 9 <> 0").select("session_date").distinct()


@query("jon_05", f"WITH {REGIMES}, {TRADES}, {DAY_REGIME} SELECT o_orderkey, session_date, expiry_weekday, regime_flag FROM trades JOIN day_regime USING (session_date)")
def _regime(t):
    return align.attach_regime(trades(t), regimes(t)).select("o_orderkey", "session_date", "expiry_weekday", "regime_flag")


@query("jon_06", f"WITH {REGIMES}, {TRADES}, {DAY_REGIME}, {OPEN_DAYS}, {EXPIRY} SELECT session_date, expiry_weekday, expiry_date FROM expiry")
def _expiry(t):
    days = align.attach_regime(trades(t).select("session_date").distinct(), regimes(t))
    return align.next_expiry(days, open_days(t)).select("session_date", "expiry_weekday", "expiry_date")


@query(
    "win_33",
    sql(
        f"""{REGIMES}, {TRADES}, {DAY_REGIME}, {OPEN_DAYS}, {EXPIRY}, final AS (SELECT o_orderkey,
  CAST(expiry_date - session_date AS DOUBLE) AS days_to_expiry, (expiry_date - session_date) / 7e0 AS dte_normalized,
  coalesce(expiry_date = session_date, false) AS is_expiry_day, CASE WHEN expiry_date IS NULL THEN 0 ELSE regime_flag END AS regime_flag
  FROM trades JOIN expiry USING (session_date))""",
        "o_orderkey, is_expiry_day, regime_flag",
        "days_to_expiry dte_normalized",
    ),
)
def _expiry_features(t):
    return align.expiry_features(trades(t), regimes(t), open_days(t)).drop("session_date")


ACTION_ROWS = """('click', DATE '2024-01-10', 2e0, NULL), ('click', DATE '2024-01-20', NULL, 1.5e0), ('signup', DATE '2024-01-15', 3e0, 2e0),
('view', DATE '2024-01-08', 0.5e0, NULL), ('view', DATE '2024-01-22', 1e0, 0.75e0), ('ghost', DATE '2024-01-09', 2e0, NULL)"""
ACTIONS = f"actions(symbol, ex_date, split_ratio, dividend_amount) AS (VALUES {ACTION_ROWS})"


def actions(t, dividends: bool = True) -> DataFrame:
    df = t.spark.sql(f"SELECT * FROM VALUES {ACTION_ROWS} AS v(symbol, ex_date, split_ratio, dividend_amount)")
    df = df.withColumns({c: F.col(c).cast("double") for c in ("split_ratio", "dividend_amount")})
    return df if dividends else df.withColumn("dividend_amount", F.lit(None).cast("double"))


def action_sql(dividend: str) -> str:
    return sql(
        f"""{BARS}, {ACTIONS}, ev AS (SELECT a.*, coalesce(split_ratio, 1e0) AS s, (SELECT arg_max(close, (ts, seq)) FROM bars b
  WHERE b.symbol = a.symbol AND b.session_date < a.ex_date) AS c FROM actions a),
fac AS (SELECT symbol, ex_date, s, 1 / s * {dividend} AS f FROM ev),
final AS (SELECT b.symbol, b.seq, b.close * coalesce((SELECT product(f) FROM fac WHERE fac.symbol = b.symbol AND fac.ex_date > b.session_date), 1) AS close,
  b.volume * coalesce((SELECT product(s) FROM fac WHERE fac.symbol = b.symbol AND fac.ex_date > b.session_date), 1) AS volume FROM bars b)""",
        "symbol, seq",
        "close volume",
    )


@query("jon_07", action_sql("1e0"))
def _splits(t):
    return align.adjust_actions(t.bars(), actions(t, dividends=False)).select("symbol", "seq", "close", "volume")


@query("jon_08", action_sql("coalesce((c / s - dividend_amount) / (c / s), 1e0)"))
def _dividends(t):
    return align.adjust_actions(t.bars(), actions(t)).select("symbol", "seq", "close", "volume")


INSTRUMENT_ROWS = "('Brand#1', 'BSE_EQ', 'BSE_EQ|INE001'), ('brand#2', 'bse_eq', 'BSE_EQ|INE002'), ('Brand#3', 'NSE_EQ', 'NSE_EQ|INE003')"


@query(
    "jon_09",
    f"""WITH ins(trading_symbol, segment, instrument_key) AS (VALUES {INSTRUMENT_ROWS}),
k AS (SELECT upper(trading_symbol) AS s, min(instrument_key) AS ik FROM ins WHERE upper(segment) = 'BSE_EQ' GROUP BY 1)
SELECT p_partkey, p_brand AS symbol, coalesce(ik, 'BSE_EQ|' || upper(p_brand)) AS instrument_key FROM part LEFT JOIN k ON s = upper(p_brand)""",
)
def _keys(t):
    dim = t.spark.sql(f"SELECT * FROM VALUES {INSTRUMENT_ROWS} AS v(trading_symbol, segment, instrument_key)")
    return align.instrument_keys(t.raw("part").select("p_partkey", F.col("p_brand").alias("symbol")), dim)


SECTOR = "CASE WHEN n % 5 = 0 THEN 'private bank' WHEN n % 5 = 1 THEN 'it services' WHEN n % 5 = 2 THEN 'energy' WHEN n % 5 = 3 THEN 'industrials' ELSE 'other' END"
WEIGHTS = f"""weights AS (SELECT symbol, sum(p_retailprice) / 1e3 AS weight, any_value({SECTOR}) AS sector FROM (
  SELECT p_brand AS symbol, p_retailprice, CAST(string_split(p_brand, '#')[2] AS INTEGER) AS n FROM part) GROUP BY symbol)"""


def weights(t) -> DataFrame:
    df = t.raw("part").select(F.col("p_brand").alias("symbol"), "p_retailprice", F.split("p_brand", "#")[1].cast("int").alias("n"))
    return df.groupBy("symbol").agg((F.sum("p_retailprice") / 1e3).alias("weight"), F.first(F.expr(SECTOR)).alias("sector"))


@query(
    "jon_10",
    sql(
        f"""{PANEL}, {WEIGHTS}, seen AS (SELECT * FROM panel WHERE symbol <> 'Brand#7'),
dim AS (SELECT symbol, sector, weight / sum(weight) OVER () AS weight FROM weights WHERE symbol IN (SELECT symbol FROM seen)),
final AS (SELECT ts, symbol, sector, weight FROM seen JOIN dim USING (symbol))""",
        "ts, symbol, sector",
        "weight",
    ),
)
def _weights(t):
    return align.attach_weights(t.panel().where("symbol <> 'Brand#7'"), weights(t)).select("ts", "symbol", "sector", "weight")


@query(
    "jon_11",
    sql(
        f"""{BARS}, blk AS (SELECT symbol, seq, close * 2 AS volume, close / 3 AS extra FROM bars WHERE seq % 3 <> 0),
final AS (SELECT bars.symbol, bars.seq, bars.close, blk.volume, blk.extra FROM bars LEFT JOIN blk USING (symbol, seq))""",
        "symbol, seq",
        "close volume extra",
    ),
)
def _assemble(t):
    b = t.bars().select("symbol", "seq", "close", "volume")
    block = b.where("seq % 3 <> 0").select(
        "symbol", "seq", F.lit(0).alias("_o"), (F.col("close") * 2).alias("volume"), (F.col("close") / 3).alias("extra")
    )
    return align.attach_first(b, block, ["symbol", "seq"], ["_o"])


@query(
    "jon_12",
    sql(
        f"""{TICKS}, {HOURLY}, opt AS (SELECT date_trunc('hour', ts) AS ts, arg_min(price, seq) AS atm, arg_min(volume, seq) AS oi FROM ticks WHERE symbol = 'view' GROUP BY 1),
final AS (SELECT hourly.symbol, hourly.ts, hourly.price, opt.atm, opt.oi FROM hourly LEFT JOIN opt USING (ts))""",
        "symbol, ts",
        "price atm oi",
    ),
)
def _options(t):
    opt = t.ticks().where("symbol = 'view'").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "seq", F.col("price").alias("atm"), F.col("volume").alias("oi")
    )
    bars = resample(t.ticks(), "1 hour").select("symbol", "ts", "price")
    return align.attach_first(bars, opt, ["ts"], ["seq"])


@query(
    "jon_13",
    f"WITH {TRADES} SELECT DISTINCT session_date FROM trades WHERE session_date NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49)",
)
def _missing(t):
    have = t.raw("lineitem").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("session_date"))
    return align.missing_days(trades(t), have)

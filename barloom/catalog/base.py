"""Registry of named queries and the driver tables they start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
#: Moves values off exact rounding ties, which the two engines resolve differently.
NUDGE = 3.1415926e-8


class Tables:
    """Domain views of the driver tables, in UTC wall time (TIMESTAMP_NTZ)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ticks(self) -> DataFrame:
        e, v = F.col("event_id"), F.col("value")
        return self.raw("events").select(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            e.alias("seq"),
            v.alias("price"),
            (v * (1.0 + (e % 5) * 2e-3)).alias("high"),
            (v * (1.0 - (e % 3) * 3e-3)).alias("low"),
            F.get_json_object("props", "$.k").cast("double").alias("volume"),
        )

    def bars(self) -> DataFrame:
        """One OHLCV bar per event, with its UTC session date."""
        t = self.ticks()
        opening = F.col("price") * (1.0 + ((F.col("seq") * 7) % 11 - 5) * 1e-3)
        return t.select(
            "symbol",
            "ts",
            "seq",
            F.to_date("ts").alias("session_date"),
            opening.alias("open"),
            (F.greatest(opening, F.col("price")) * 1.001).alias("high"),
            (F.least(opening, F.col("price")) * 0.999).alias("low"),
            F.col("price").alias("close"),
            "volume",
        )

    def wild(self) -> DataFrame:
        """Ticks as a feed delivers them: hour-stamped duplicates, gaps, bad signs, crossed highs and lows."""
        s = F.col("seq")
        return self.ticks().select(
            "symbol",
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
            "seq",
            F.when(s % 97 != 0, F.when(s % 89 == 0, -F.col("price")).otherwise(F.col("price"))).alias("price"),
            F.when(s % 83 == 0, 0.0).otherwise(F.col("high")).alias("high"),
            F.when(s % 79 == 0, F.col("high") * 1.5).otherwise(F.col("low")).alias("low"),
            F.when(s % 73 == 0, -1.0).when(s % 71 != 0, F.col("volume")).alias("volume"),
        )

    def rough(self) -> DataFrame:
        """Session bars with silent stretches, frozen quotes and missing closes."""
        b, s = self.bars(), F.col("seq")
        frozen = (s / 40).cast("long") % 3 == 0
        px = {c: F.when(frozen, F.lit(float(i + 10))).otherwise(F.col(c)) for i, c in enumerate(("low", "open", "close", "high"))}
        b = b.withColumns(px).withColumn("volume", F.when((s / 60).cast("long") % 2 == 0, 0.0).otherwise(F.col("volume")))
        return b.withColumns({c: F.when(s % 6 > 2, F.col(c)) for c in ("open", "close")})

    def panel(self) -> DataFrame:
        """Daily constituent panel: brand closes from line items."""
        li = self.raw("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        pt = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        return (
            li.join(pt, "l_partkey")
            .groupBy(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "symbol")
            .agg(
                (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
        )


    def panel_returns(self) -> DataFrame:
        """Panel with log returns per brand and a stale flag."""
        w = Window.partitionBy("symbol").orderBy("ts")
        r = F.ln(F.col("close") / F.lag("close", 1).over(w))
        return self.panel().select("ts", "symbol", r.alias("log_ret"), (F.col("volume") < 5).alias("is_stale"))

    def chain(self) -> DataFrame:
        """Option rows from line items: the ship date is the slice."""
        day, strike = F.dayofmonth("l_shipdate"), 100.0 + (F.col("l_partkey") % 40) * 5
        noise = F.when(F.col("l_orderkey") % 37 == 0, 0.5).otherwise(F.col("l_discount") * 0.1)
        return self.raw("lineitem").select(
            F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("part"),
            strike.alias("strike"),
            F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("p").alias("option_type"),
            (0.2 + (strike - 200.0) * (strike - 200.0) * 4e-6 + noise).alias("iv"),
            (F.col("l_tax") * 10).alias("delta"),
            (F.col("l_discount") / 10).alias("gamma"),
            (F.col("l_quantity") / 10).alias("vega"),
            F.col("l_quantity").alias("volume"),
            F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey").cast("double")).alias("oi"),
            F.when(day % 7 != 0, 200.0 + day % 11).alias("spot"),
        )

# CTE texts that give DuckDB the same domain views.
TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  value * (1e0 + (event_id % 5) * 2e-3) AS high, value * (1e0 - (event_id % 3) * 3e-3) AS low,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"""
BARS = (
    TICKS
    + """, bars0 AS (SELECT *, price * (1e0 + ((seq * 7) % 11 - 5) * 1e-3) AS open FROM ticks),
bars AS (SELECT symbol, ts, seq, CAST(ts AS DATE) AS session_date, open,
  greatest(open, price) * 1.001e0 AS high, least(open, price) * 0.999e0 AS low, price AS close, volume FROM bars0)"""
)
WILD = (
    TICKS
    + """, wild AS (SELECT symbol, date_trunc('hour', ts) AS ts, seq,
  CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN -price ELSE price END AS price,
  CASE WHEN seq % 83 = 0 THEN 0e0 ELSE high END AS high,
  CASE WHEN seq % 79 = 0 THEN high * 1.5e0 ELSE low END AS low,
  CASE WHEN seq % 73 = 0 THEN -1e0 WHEN seq % 71 = 0 THEN NULL ELSE volume END AS volume FROM ticks)"""
)
ROUGH = (
    BARS
    + """, rough0 AS (SELECT *, (seq // 40) % 3 = 0 AS frozen FROM bars),
rough AS (SELECT symbol, ts, seq, session_date,
  CASE WHEN seq % 6 > 2 THEN CASE WHEN frozen THEN 11e0 ELSE open END END AS open,
  CASE WHEN frozen THEN 13e0 ELSE high END AS high, CASE WHEN frozen THEN 10e0 ELSE low END AS low,
  CASE WHEN seq % 6 > 2 THEN CASE WHEN frozen THEN 12e0 ELSE close END END AS close,
  CASE WHEN (seq // 60) % 2 = 0 THEN 0e0 ELSE volume END AS volume FROM rough0)"""
)
PANEL = """panel AS (SELECT l_shipdate AS ts, p_brand AS symbol, sum(l_extendedprice) / sum(l_quantity) AS close,
  sum(l_quantity) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def tidy(df: DataFrame) -> DataFrame:
    """Round floating columns so that both engines print the same value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + NUDGE, DIGITS)
        out.append(c.alias(f.name))
    return df.select(*out)


def sql(ctes: str, ids: str, nums: str = "", source: str = "final") -> str:
    """Final SELECT with identifiers as they are and numbers rounded."""
    cols = [c.strip() for c in ids.split(",") if c.strip()]
    cols += [f"round({n} + {NUDGE!r}, {DIGITS}) + 0e0 AS {n}" for n in nums.split()]
    return f"WITH {ctes} SELECT {', '.join(cols)} FROM {source}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL counterpart."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def scan(source: str, x: str, step: str, keys: str = "symbol", order: str = "ts, seq", name: str = "y", ident: str = "seq") -> str:
    """DuckDB text of a running recurrence: ``step`` combines the state $a with the input $x, the first input is the start."""
    return f"""(SELECT {keys}, unnest(ids) AS {ident}, unnest(ys) AS {name} FROM (
  SELECT {keys}, list({ident} ORDER BY {order}) AS ids,
    list_reduce(list_transform(list({x} ORDER BY {order}), lambda x: [x]),
      lambda acc, v: list_append(acc, ({step.replace('$a', 'acc[-1]').replace('$x', 'v[1]')}))) AS ys
  FROM {source} GROUP BY {keys}))"""


PANEL_RETURNS = PANEL + """, panel_returns AS (SELECT ts, symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS log_ret,
  volume < 5 AS is_stale FROM panel)"""
CHAIN = """chain AS (SELECT l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, 100e0 + (l_partkey % 40) * 5 AS strike,
  CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'p' END AS option_type,
  2e-1 + (100e0 + (l_partkey % 40) * 5 - 200e0) * (100e0 + (l_partkey % 40) * 5 - 200e0) * 4e-6 + CASE WHEN l_orderkey % 37 = 0 THEN 5e-1 ELSE l_discount * 1e-1 END AS iv,
  l_tax * 10 AS delta, l_discount / 10 AS gamma, l_quantity / 10 AS vega, l_quantity AS volume,
  CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_suppkey AS DOUBLE) END AS oi, CASE WHEN day(l_shipdate) % 7 <> 0 THEN 200e0 + day(l_shipdate) % 11 END AS spot FROM lineitem)"""

"""Streaming queries: the event table is read as a stream, drained, and the written rows are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import TICKS, query, sql
from barloom.catalog.files import fresh
from barloom.catalog.indicators import KALMAN, RSI, ewm_sql
from barloom.functions.scalars import utc_wall
from barloom.streaming import bars, latency, ordered

SPLIT = "symbol, seq"


def ticks(t):
    """Same columns as the tick table, from a streaming read."""
    schema = t.raw("events").schema
    e, v = F.col("event_id"), F.col("value")
    return bars.tick_stream(t.spark, t.folder, schema, "events.parquet").select(
        F.col("event_type").alias("symbol"),
        "ts",
        e.alias("seq"),
        v.alias("price"),
        (v * (1.0 + (e % 5) * 2e-3)).alias("high"),
        (v * (1.0 - (e % 3) * 3e-3)).alias("low"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def drained(t, stream, name: str):
    folder = fresh(t, name)
    q = bars.drain(stream, folder)
    return q, t.spark.read.parquet(f"{folder}/rows")


CLOSED = "(SELECT max(ts) - INTERVAL 2 MINUTE FROM ticks)"


@query(
    "str_01",
    sql(
        f"""{TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_max(price, (ts, seq)) AS price, max(high) AS high, min(low) AS low, sum(volume) AS volume
  FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts)), final AS (SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= {CLOSED})""",
        "symbol, ts",
        "price high low volume",
    ),
)
def _bars(t):
    _, out = drained(t, bars.stream_bars(ticks(t), "1 hour"), "stream-bars")
    return out.withColumn("ts", utc_wall(F.col("ts")))


def replayed(t, build, name: str, late: int = 3600, parts: int = 2):
    """Ticks that arrive up to ``late`` seconds behind their time, in ``parts`` drains of one query, which goes on from its
    checkpoint each time; then a heartbeat of the day after, which moves the watermark past all ticks."""
    source, folder = fresh(t, f"{name}-in"), fresh(t, name)
    rows = t.ticks().withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_due", F.unix_seconds("ts") + F.pmod(F.xxhash64("seq"), F.lit(late)))
    first, last = rows.agg(F.min("_due"), F.max("_due")).first()
    schema = rows.drop("_due").schema
    for k in range(parts + 1):
        if k < parts:
            part = F.floor((F.col("_due") - first) * parts / (last - first + 1)) == k
            batch = rows.where(part).drop("_due")
        else:
            beat = {"symbol": F.lit("heartbeat"), "ts": F.timestamp_seconds(F.lit(last + 86_400)), "seq": F.lit(-1).cast("long")}
            batch = t.spark.range(1).select(*[beat.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        batch.write.mode("append").parquet(source)
        bars.drain(build(bars.tick_stream(t.spark, source, schema)), folder)
    return t.spark.read.parquet(f"{folder}/rows")


LATE = {"delay": "2 hours", "bucket": "6 hours"}


@query("str_02", sql(f"{TICKS}, final AS (SELECT symbol, seq, CASE WHEN count(price) OVER w = 10 THEN avg(price) OVER w END AS score FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))", SPLIT, "score"))
def _buffer(t):
    out = replayed(t, lambda s: ordered.stream_scores(s, 10, **LATE), "stream-scores")
    return out.select("symbol", "seq", F.nanvl("score", F.lit(None).cast("double")).alias("score"))


@query(
    "str_03",
    sql(
        f"""{TICKS}, {RSI}, {KALMAN}, final AS (SELECT symbol, seq, ema, rsi_14 AS rsi, kalman_price
  FROM {ewm_sql('t1', 'price', '(2e0/13)', 'ema', 12)} JOIN rsi USING (symbol, seq) JOIN k USING (symbol, seq))""",
        SPLIT,
        "ema rsi kalman_price",
    ),
)
def _recurrences(t):
    out = replayed(t, lambda s: ordered.stream_recurrences(s, **LATE), "stream-recurrences")
    clean = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("ema", "rsi")}
    return out.select("symbol", "seq", *[v.alias(k) for k, v in clean.items()], "kalman_price")


@query(
    "str_04",
    sql(
        f"""{TICKS}, m AS (SELECT * REPLACE (date_trunc('minute', ts) AS ts) FROM ticks),
final AS (SELECT symbol, ts, min(seq) AS seq, arg_min(price, seq) AS price, arg_min(volume, seq) AS volume FROM m GROUP BY symbol, ts)""",
        "symbol, ts, seq",
        "price volume",
    ),
)
def _first(t):
    """The tick that is kept of each minute, of ticks that arrive late and out of order."""
    minute = lambda s: s.withColumn("ts", F.date_trunc("minute", "ts"))
    out = replayed(t, lambda s: ordered.stream_first(minute(s), ["price", "volume"], **LATE), "stream-first")
    return out.select("symbol", utc_wall(F.col("ts")).alias("ts"), "seq", "price", "volume")


@query(
    "str_05",
    f"""WITH {TICKS}, g AS (SELECT symbol, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (
  SELECT symbol, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts) + INTERVAL 15 MINUTE, true) AS gap FROM ticks WHERE volume > 0))
SELECT symbol, min(ts) AS active_from, max(ts) + INTERVAL 15 MINUTE AS stale_since, count(*) AS trades FROM g GROUP BY symbol, run""",
)
def _stale(t):
    out = replayed(t, lambda s: ordered.stream_stale(s, "15 minutes", **LATE), "stream-stale")
    return out.withColumns({c: utc_wall(F.col(c)) for c in ("active_from", "stale_since")})


@query("str_06")
def _budget(t):
    q, _ = drained(t, bars.stream_bars(ticks(t), "1 minute"), "stream-latency")
    return latency.latency_budget(latency.stage_times(t.spark, q))

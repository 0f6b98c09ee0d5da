"""Source and sink queries.  Files are written from the driver tables to the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.catalog.base import BARS, PANEL, TICKS, query, sql
from barloom.functions.scalars import read_timestamp
from barloom.operators.bars import resample
from barloom.schema import DEFAULT_REGIME, REGIMES
from barloom.session import checkpoint_dir
from barloom.sources import payloads, readers, sinks, sorted_csv

NUMS = ["price", "high", "low", "volume"]


def fresh(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/tables/{name}-{uuid.uuid4().hex}"


def mixed_text(ts: str = "ts"):
    """Second-resolution stamps in two formats."""
    return F.when(F.col("seq") % 2 == 0, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


SECONDS = "date_trunc('second', ts)"


@query("src_01", sql(f"{TICKS}, final AS (SELECT symbol, seq, {SECONDS} AS ts, price, volume FROM ticks)", "symbol, seq, ts", "price volume"))
def _csv(t):
    path = fresh(t, "csv")
    t.ticks().select(mixed_text().alias("timestamp"), "symbol", "seq", *NUMS).write.option("header", True).csv(path)
    df = readers.read_bars_csv(t.spark, path, NUMS, others=["symbol", "seq"])
    return df.select("symbol", F.col("seq").cast("long").alias("seq"), "ts", "price", "volume")


@query("src_02", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE ELSE date_trunc('second', ts) END AS ts FROM events")
def _zoned(t):
    e = F.col("event_id")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(e % 3 == 0, text).when(e % 3 == 1, F.concat(text, F.lit("+05:30"))).otherwise(F.concat(text, F.lit("+00:00")))
    return t.raw("events").select("event_id", read_timestamp(text, zone="Asia/Kolkata").alias("ts"))


def day_table(t) -> str:
    path = fresh(t, "days")
    sinks.write_days(t.bars().select("symbol", "seq", "ts", "close", "volume", "session_date"), path)
    return path


@query("src_03", sql(f"{BARS}, final AS (SELECT *, {SECONDS} AS stamp FROM bars WHERE session_date = DATE '2024-01-15')", "symbol, seq, stamp", "close volume"))
def _one_day(t):
    """All bars as CSV files sorted by time, of which the scan reads one day's bytes."""
    path = fresh(t, "sorted-csv")
    cells = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "symbol", "seq", "close", "volume"]
    t.bars().orderBy("ts", "seq").select(*cells).write.option("header", True).csv(path)
    day = sorted_csv.read_day_csv(t.spark, path, "2024-01-15", ["close", "volume"], ["symbol", "seq"])
    return day.select("symbol", F.col("seq").cast("long").alias("seq"), F.col("ts").alias("stamp"), "close", "volume")


@query(
    "src_04",
    sql(f"{BARS}, final AS (SELECT symbol, seq, close AS price, high, low, volume FROM bars)", "symbol, seq", "price high low volume"),
)
def _tree(t):
    """Nested day folders with source column names; half of the files come without a volume alias."""
    path = fresh(t, "tree")
    b = t.bars()
    cols = ["symbol", "seq", F.col("ts").alias("timestamp"), *[F.col(a).alias(f"idx_{a}") for a in ("close", "high", "low", "volume")]]
    b.where("day(session_date) % 2 = 0").select(*cols).repartition(2).write.parquet(f"{path}/2024/even")
    b.where("day(session_date) % 2 = 1").select(*cols).repartition(2).write.parquet(f"{path}/2024/odd")
    return readers.read_tick_tree(t.spark, path).select("symbol", "seq", *NUMS)


@query("src_05", sql(f"{TICKS}, final AS (SELECT symbol, seq, price, high, low, volume FROM ticks WHERE seq % 5 <> 0)", "symbol, seq", "price high low volume"))
def _single(t):
    path = fresh(t, "ticks") + ".parquet"
    df = t.ticks().withColumnRenamed("ts", "timestamp").withColumn("price", F.when(F.col("seq") % 5 != 0, F.col("price")))
    df.write.parquet(path)
    return readers.read_ticks(t.spark, path).select("symbol", "seq", *NUMS)


@query("src_06", f"WITH {BARS} SELECT symbol, seq, CASE WHEN seq % 10 > 0 THEN session_date END AS session_date FROM bars WHERE seq % 10 = 0 OR session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def _range(t):
    b = t.bars().withColumn("session_date", F.when(F.col("seq") % 10 > 0, F.col("session_date")))
    return readers.stage_range(b, "2024-01-05", "2024-01-09").select("symbol", "seq", "session_date")


LISTED = "('2024-01-03'), ('2024-01-17'), ('2024-02-28')"


@query(
    "src_07",
    f"""WITH {BARS}, d AS (SELECT CAST(d AS DATE) AS session_date FROM (VALUES {LISTED}) v(d))
SELECT 'row' AS kind, session_date, symbol, seq, round(close + 3.1415926e-08, 6) + 0e0 AS close FROM bars WHERE session_date IN (FROM d)
UNION ALL SELECT 'missing', session_date, NULL, NULL, NULL FROM d WHERE session_date NOT IN (SELECT session_date FROM bars)""",
)
def _listed(t):
    days = t.spark.sql(f"SELECT CAST(d AS DATE) AS session_date FROM VALUES {LISTED} AS v(d)")
    rows, missing = readers.feature_range(t.bars(), days)
    have = rows.select(F.lit("row").alias("kind"), "session_date", "symbol", "seq", "close")
    return have.unionByName(missing.select(F.lit("missing").alias("kind"), "session_date"), allowMissingColumns=True)


@query("src_09", f"WITH {TICKS} SELECT symbol, seq, {SECONDS} AS ts, volume AS open, volume + 3 AS high, volume - 2 AS low, volume + 1 AS close, CAST(seq AS DOUBLE) AS volume FROM ticks WHERE seq % 6 <> 5")
def _candles(t):
    v = F.col("volume").cast("int")
    cells = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), v, v + 3, v - 2, v + 1]
    quoted = F.concat(F.lit('"'), cells[0], F.lit('"'))
    row = F.concat(F.lit("["), F.concat_ws(",", quoted, *cells[1:], F.when(F.col("seq") % 6 != 5, F.col("seq"))), F.lit("]"))
    s = F.col("seq") % 3
    doc = (
        F.when(s == 0, F.concat(F.lit("["), row, F.lit("]")))
        .when(s == 1, F.concat(F.lit('{"candles": ['), row, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"data": {"candles": ['), row, F.lit("]}}")))
    )
    return payloads.candles(t.ticks().select("symbol", "seq", doc.alias("doc")), "doc", ("symbol", "seq"))


CHAIN_SQL = """SELECT p_partkey, CAST(p_size AS DOUBLE) AS strike, 'C' AS option_type, p_size / 100e0 AS iv, p_size * 1e0 AS delta, CAST(p_partkey AS DOUBLE) AS oi FROM part WHERE p_partkey % 4 IN (0, 1)
UNION ALL SELECT p_partkey, p_size, 'P', CASE p_partkey % 4 WHEN 0 THEN p_size / 50e0 END, CASE p_partkey % 4 WHEN 0 THEN p_size * 2e0 END, 0 FROM part WHERE p_partkey % 4 IN (0, 1)
UNION ALL SELECT p_partkey, p_size, 'P', p_size / 25e0, NULL, p_partkey + 1 FROM part WHERE p_partkey % 4 = 2"""


@query("src_10", f"SELECT p_partkey, strike, option_type, round(iv, 6) AS iv, delta, oi FROM ({CHAIN_SQL})")
def _chain(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    body = F.when(
        key % 4 == 0,
        F.format_string(
            '{"data": [{"strike_price": %d, "call_options": {"market_data": {"oi": %d}, "option_greeks": {"iv": %.2f, "delta": %d}}, "put_options": {"iv": %.2f, "delta": %d, "oi": null}}]}',
            size, key, size / 100, size, size / 50, size * 2,
        ),
    ).when(
        key % 4 == 1,
        F.format_string('[{"strike": %d, "call_options": {"implied_volatility": %.2f, "delta": %d, "open_interest": %d}, "put_options": {"iv": null}}]', size, size / 100, size, key),
    ).when(
        key % 4 == 2, F.format_string('{"strikePrice": %d, "type": "P", "iv": %.2f, "open_interest": %d}', size, size / 25, key + 1)
    ).otherwise(F.lit('{"data": [{"iv": 0.2}]}'))
    rows = payloads.option_rows(t.raw("part").select("p_partkey", body.alias("doc")), "doc", ("p_partkey",))
    return rows.select("p_partkey", "strike", "option_type", "iv", "delta", "oi")


@query(
    "src_11",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS a, event_type AS b FROM events WHERE event_id % 5 < 4
UNION ALL SELECT event_id, CAST(user_id AS VARCHAR), 'x' FROM events WHERE event_id % 5 IN (0, 3)""",
)
def _records(t):
    e, u, b = F.col("event_id"), F.col("user_id"), F.col("event_type")
    one = F.format_string('{"a": %d, "b": "%s"}', e, b)
    two = F.format_string('{"a": %d, "b": "x"}', u)
    doc = (
        F.when(e % 5 == 0, F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
        .when(e % 5 == 1, F.concat(F.lit('{"data": '), one, F.lit("}")))
        .when(e % 5 == 2, F.concat(F.lit('{"instruments": ['), one, F.lit("]}")))
        .when(e % 5 == 3, F.format_string("a,b\n%d,%s\n%d,x\n", e, b, u))
        .otherwise(F.lit("no records"))
    )
    rows = payloads.records(t.raw("events").select("event_id", doc.alias("doc")), "doc", ("event_id",))
    return rows.select("event_id", F.col("record")["a"].alias("a"), F.col("record")["b"].alias("b"))


@query("src_12", "SELECT DISTINCT p_brand AS trading_symbol, 'BSE_EQ' AS segment, 'BSE_EQ|' || p_brand AS instrument_key FROM part WHERE p_size > 10")
def _master(t):
    path = fresh(t, "instruments")
    dim = t.raw("part").select(
        F.col("p_brand").alias("trading_symbol"), F.lit("BSE_EQ").alias("segment"), F.concat(F.lit("BSE_EQ|"), "p_brand").alias("instrument_key"), "p_size"
    )
    for rows in (dim.where("p_size <= 10"), dim.where("p_size > 10")):
        sinks.replace_dimension(rows.drop("p_size").distinct(), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("trading_symbol", "segment", "instrument_key")])
    return readers.dimension(t.spark, path, schema)


@query(
    "src_13",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date, 3 AS expiry_weekday, 0 AS regime_flag FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2030-12-31'""",
)
def _default(t):
    regimes = readers.dimension(t.spark, fresh(t, "absent"), REGIMES, DEFAULT_REGIME)
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("session_date")).distinct()
    return days.join(F.broadcast(regimes), F.col("session_date").between(F.col("date_from"), F.col("date_to"))).select(
        "session_date", "expiry_weekday", "regime_flag"
    )


@query("src_14", sql(f"{PANEL}, final AS (SELECT ts, symbol, close AS price FROM panel)", "ts, symbol", "price"))
def _constituents(t):
    df = t.panel().select(F.col("ts").alias("timestamp"), F.col("symbol").alias("ticker"), F.lit(1.0).alias("ltp"), "close")
    return readers.constituents(df)


def back(t, path):
    return t.spark.read.parquet(path)


@query("snk_01", sql(f"{BARS}, final AS (SELECT symbol, seq, session_date, CASE WHEN session_date = DATE '2024-01-02' THEN close * 2 ELSE close END AS close, '3.0' AS version FROM bars)", "symbol, seq, session_date, version", "close"))
def _days(t):
    """The second write replaces one day and leaves the others."""
    path = day_table(t)
    again = t.bars().where("session_date = DATE '2024-01-02'").withColumn("close", F.col("close") * 2)
    sinks.write_days(again.select("symbol", "seq", "ts", "close", "volume", "session_date"), path)
    df = back(t, path)
    return df.select("symbol", "seq", "session_date", "close", F.lit(df.schema["close"].metadata["schema_version"]).alias("version"))


SNK = "symbol, seq, session_date, round(close + 3.1415926e-08, 6) + 0e0 AS close"


@query("snk_02", f"WITH {BARS} SELECT 'clean' AS stage, '3.0' AS version, {SNK} FROM bars UNION ALL SELECT 'features', '3.0', {SNK} FROM bars WHERE seq % 2 = 0")
def _stages(t):
    """All rows of both stages as read back, with the stage and version that the files carry."""
    out = None
    for stage, rows in (("clean", t.bars()), ("features", t.bars().where("seq % 2 = 0"))):
        path = fresh(t, stage)
        sinks.write_days(rows.select("symbol", "seq", "close", "session_date"), path, stage, spread=2)
        read = back(t, path)
        says = read.schema["close"].metadata
        read = read.select(F.lit(says["stage"]).alias("stage"), F.lit(says["schema_version"]).alias("version"), "symbol", "seq", "session_date", "close")
        out = read if out is None else out.unionByName(read)
    return out


FOLDS = "SELECT event_id, event_id % 3 + 1 AS fold, CASE WHEN user_id % 2 = 0 THEN 'sequence' ELSE 'tree' END AS family, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS role, value FROM events"


def folds(t):
    e = F.col("event_id")
    return t.raw("events").select(
        "event_id",
        (e % 3 + 1).alias("fold"),
        F.when(F.col("user_id") % 2 == 0, "sequence").otherwise("tree").alias("family"),
        F.when(e % 5 == 0, "val").otherwise("train").alias("role"),
        "value",
    )


@query("snk_03", sql(f"final AS ({FOLDS})", "event_id, fold, family, role", "value"))
def _folds(t):
    path = fresh(t, "folds")
    sinks.write_folds(folds(t), path)
    return back(t, path).select("event_id", F.col("fold").cast("long").alias("fold"), "family", "role", "value")


@query("snk_04", sql(f"{TICKS}, final AS (SELECT symbol, {SECONDS} AS ts, CAST({SECONDS} AS DATE) AS session_date, price, volume FROM ticks)", "symbol, ts, session_date", "price volume"))
def _convert(t):
    """One CSV folder per symbol in, one partitioned table out."""
    folder = fresh(t, "feeds")
    df = t.ticks().select(mixed_text().alias("timestamp"), "price", "volume", F.concat("symbol", F.lit("_1min.csv")).alias("name"))
    for name in ("click", "error", "purchase", "signup", "view"):
        df.where(F.col("name") == f"{name}_1min.csv").drop("name").write.option("header", True).csv(f"{folder}/{name}_1min.csv")
    path = fresh(t, "converted")
    sinks.convert_csv(t.spark, f"{folder}/*.csv", ["price", "volume"], path)
    return back(t, path).select("symbol", "ts", "session_date", "price", "volume")


@query("snk_06", sql(f"{TICKS}, final AS (SELECT symbol, seq, price AS prediction, avg(price) OVER () AS mean, max(price) OVER () AS highest, count(*) OVER () AS n FROM ticks)", "symbol, seq, n", "prediction mean highest"))
def _predictions(t):
    """The prediction rows next to the summary, both read back."""
    folder = fresh(t, "predictions")
    rows = t.ticks().select("symbol", "seq", F.col("price").alias("prediction"))
    summary = rows.agg(F.avg("prediction").alias("mean"), F.max("prediction").alias("highest"), F.count(F.lit(1)).alias("n"))
    sinks.write_predictions(rows, summary, folder)
    read = t.spark.read.schema("symbol STRING, seq BIGINT, prediction DOUBLE").option("header", True).csv(f"{folder}/predictions")
    metrics = t.spark.read.schema("mean DOUBLE, highest DOUBLE, n BIGINT").json(f"{folder}/metrics")
    return read.crossJoin(F.broadcast(metrics))  # one row


@query("snk_07", "SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-21'")
def _pending(t):
    path = fresh(t, "done")
    b = t.bars()
    sinks.write_days(b.where("session_date < DATE '2024-01-21'").select("symbol", "close", "session_date"), path)
    return sinks.pending_days(b, back(t, path))


@query(
    "snk_08",
    f"""SELECT f.fold, m.family, r.role FROM (SELECT unnest(range(1, 6)) AS fold) f, (VALUES ('sequence'), ('tree')) m(family), (VALUES ('train'), ('val')) r(role)
WHERE (f.fold, m.family, r.role) NOT IN (SELECT (fold, family, role) FROM ({FOLDS}))""",
)
def _complete(t):
    made = folds(t)
    want = t.spark.range(1, 6).select(
        F.col("id").alias("fold"), F.explode(F.array(F.lit("sequence"), F.lit("tree"))).alias("family")
    ).withColumn("role", F.explode(F.array(F.lit("train"), F.lit("val"))))
    return sinks.missing_outputs(want, made)


@query(
    "agg_27",
    f"WITH {TICKS} SELECT symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS session_date FROM ticks WHERE CAST(ts + INTERVAL 330 MINUTE AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL",
)
def _days_in(t):
    from barloom.operators.align import local_day
    from barloom.operators.bars import trading_days

    return trading_days(t.ticks(), local_day(), "2024-01-05", "2024-01-20", ["symbol"])


@query("mat_07", sql(f"{TICKS}, final AS (SELECT symbol, time_bucket(INTERVAL 1 MINUTE, ts) AS ts, arg_max(price, (ts, seq)) AS price, sum(volume) AS volume FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 MINUTE, ts))", "symbol, ts", "price volume"))
def _market_frame(t):
    from barloom.plans.pipeline import market_frame

    return market_frame(t.ticks(), min_rows=500).select("symbol", "ts", "price", "volume")

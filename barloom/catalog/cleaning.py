"""Projection, filter, cleaning, set, top-k and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, ROUGH, TICKS, WILD, query, sql
from barloom.functions import scalars as fn
from barloom.operators import clean
from barloom.operators.bars import resample
from barloom.plans.steps import on_series
from barloom.schema import PASS_THROUGH

LAG = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
VALID = "price > 0 AND high > 0 AND low > 0 AND volume >= 0 AND high >= low"

# -- projections and filters -----------------------------------------------------------------------


@query("prj_01", sql(f"{BARS}, final AS (SELECT symbol, seq, close AS price, high, low, volume FROM bars)", "symbol, seq", "price high low volume"))
def _aliases(t):
    src = t.bars().select("symbol", "seq", *[F.col(a).alias(f"idx_{a}") for a in ("close", "high", "low", "volume")])
    return clean.rename_aliases(src)


RAW_NUMBER = "CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN '' ELSE json_extract_string(props, '$.k') END"


@query("prj_02", f"SELECT event_id, TRY_CAST({RAW_NUMBER} AS DOUBLE) AS k FROM events")
def _numbers(t):
    e = F.col("event_id")
    raw = F.when(e % 7 == 0, "n/a").when(e % 11 == 0, "").otherwise(F.get_json_object("props", "$.k"))
    return clean.coerce_numbers(t.raw("events").select("event_id", raw.alias("k")), ["k"])


@query(
    "prj_03",
    """SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 13 <> 0""",
)
def _times(t):
    e = t.raw("events")
    text = F.when(F.col("event_id") % 13 == 0, "not a time").when(
        F.col("event_id") % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")
    ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", fn.read_timestamp(text).alias("ts")).where("ts IS NOT NULL")


@query("prj_04", sql(f"{WILD}, final AS (SELECT * FROM wild WHERE {VALID})", "symbol, ts, seq", "price high low volume"))
def _valid(t):
    return clean.valid_ticks(t.wild())


@query(
    "prj_05",
    sql(f"{WILD}, final AS (SELECT * FROM wild QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) = 1)", "symbol, ts, seq", "price high low volume"),
)
def _first(t):
    return clean.first_per(t.wild())


@query(
    "prj_06",
    f"""WITH {WILD} SELECT symbol, count(*) AS start_rows, count(*) FILTER ({VALID}) AS kept_rows,
  count(*) - count(*) FILTER ({VALID}) AS dropped_rows FROM wild GROUP BY symbol""",
)
def _accounting(t):
    p, h, lo, v = (F.col(c) for c in ("price", "high", "low", "volume"))
    return clean.row_accounting(t.wild(), (p > 0) & (h > 0) & (lo > 0) & (v >= 0) & (h >= lo))


LOCAL = "ts + INTERVAL 330 MINUTE"


@query(
    "prj_07",
    f"""WITH {TICKS} SELECT symbol, seq, CAST({LOCAL} AS DATE) AS session_date FROM ticks
WHERE strftime({LOCAL}, '%H:%M:%S') BETWEEN '09:15:00' AND '15:29:00'""",
)
def _hours(t):
    return clean.session_hours(t.ticks()).select("symbol", "seq", "session_date")


@query(
    "prj_08",
    f"""WITH {TICKS} SELECT symbol, seq, CAST({LOCAL} AS DATE) AS session_date,
  row_number() OVER (PARTITION BY symbol, CAST({LOCAL} AS DATE) ORDER BY ts, seq) - 1 AS bar_index FROM ticks""",
)
def _index(t):
    df = t.ticks().withColumn("session_date", F.to_date(fn.exchange_wall(F.col("ts"))))
    return clean.session_index(df).select("symbol", "seq", "session_date", "bar_index")


ODD = """odd AS (SELECT symbol, ts, seq, open, CASE WHEN seq % 50 = 0 THEN low * 0.5e0 ELSE high END AS high,
  CASE WHEN seq % 61 = 0 THEN -low ELSE low END AS low, close, CASE WHEN seq % 67 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


def odd(t):
    s = F.col("seq")
    return t.bars().withColumns(
        {
            "high": F.when(s % 50 == 0, F.col("low") * 0.5).otherwise(F.col("high")),
            "low": F.when(s % 61 == 0, -F.col("low")).otherwise(F.col("low")),
            "volume": F.when(s % 67 == 0, -F.col("volume")).otherwise(F.col("volume")),
        }
    )


@query(
    "prj_09",
    sql(
        f"""{BARS}, {ODD}, chk AS (SELECT *, coalesce(high < greatest(open, close) OR low > least(open, close) OR open <= 0 OR high <= 0
  OR low <= 0 OR close <= 0 OR volume < 0 OR coalesce(abs(ln((close + 1e-8) / (lag(close) {LAG} + 1e-8))), 0) >= 0.2, false) AS is_invalid_bar FROM odd),
final AS (SELECT symbol, seq, is_invalid_bar, {', '.join(f'CASE WHEN NOT is_invalid_bar THEN {c} END AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM chk)""",
        "symbol, seq, is_invalid_bar",
        "open high low close",
    ),
)
def _quarantine(t):
    return on_series(odd(t), clean.quarantine()).select("symbol", "seq", "is_invalid_bar", "open", "high", "low", "close")


@query(
    "prj_10",
    sql(f"{TICKS}, final AS (SELECT symbol, seq, price / (volume - 50) AS x, price FROM ticks WHERE volume <> 50 AND seq % 41 <> 0)", "symbol, seq", "x price"),
)
def _complete(t):
    v = F.col("volume") - 50
    x = F.when(v == 0, float("inf")).otherwise(F.col("price") / F.when(v != 0, v))
    df = t.ticks().select("symbol", "seq", x.alias("x"), F.when(F.col("seq") % 41 != 0, F.col("price")).alias("price"))
    return clean.drop_incomplete(df, ["x", "price"])


@query(
    "prj_11",
    sql(
        f"""{BARS}, final AS (SELECT symbol, seq, CAST(close AS FLOAT)::DOUBLE AS close, CAST(volume AS INTEGER) AS volume,
  CAST(seq % 100 AS SMALLINT) AS bar_index, CAST(seq % 2 AS TINYINT) AS flag FROM bars)""",
        "symbol, seq, volume, bar_index, flag",
        "close",
    ),
)
def _narrow(t):
    df = t.bars().select("symbol", "seq", "close", "volume", (F.col("seq") % 100).alias("bar_index"), (F.col("seq") % 2).alias("flag"))
    return clean.narrow(df, keep=("seq",)).withColumn("close", F.col("close").cast("double"))


PRESENT = [c for c in PASS_THROUGH if c != "session_date"][:-2]  # the last two are absent from the source


def pass_sql(k: int, c: str) -> str:
    if c == "session_date":
        return c
    return f"round(close * {k + 1} + 3.1415926e-08, 6) + 0e0 AS {c}" if c in PRESENT else f"NULL::DOUBLE AS {c}"


@query("prj_12", f"""WITH {BARS} SELECT symbol, seq, {', '.join(pass_sql(k, c) for k, c in enumerate(PASS_THROUGH))} FROM bars""")
def _pass(t):
    made = {c: F.col("close") * (PASS_THROUGH.index(c) + 1) for c in PRESENT}
    return clean.project(t.bars().withColumns(made), ["symbol", "seq"], PASS_THROUGH)


@query(
    "prj_13",
    sql(
        f"""{WILD}, final AS (SELECT symbol, seq, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS {c}' for c in ('price', 'volume'))} FROM wild)""",
        "symbol, seq",
        "price volume",
    ),
)
def _ffill(t):
    return clean.fill_forward(t.wild(), ["price", "volume"]).select("symbol", "seq", "price", "volume")


@query(
    "prj_16",
    sql(
        """final AS (SELECT p_partkey, option_type, CASE option_type WHEN 'C' THEN p_retailprice / 5e3 ELSE p_retailprice / 4e3 END AS iv,
  CASE option_type WHEN 'C' THEN p_size ELSE p_size + 1 END AS oi FROM part, (VALUES ('C'), ('P')) s(option_type))""",
        "p_partkey, option_type, oi",
        "iv",
    ),
)
def _sides(t):
    p = F.col("p_retailprice")
    df = t.raw("part").select(
        "p_partkey", (p / 5e3).alias("ce_iv"), (p / 4e3).alias("pe_iv"), F.col("p_size").alias("ce_oi"), (F.col("p_size") + 1).alias("pe_oi")
    )
    return clean.sides_to_rows(df, ["p_partkey"], ["iv", "oi"])


# -- stale feeds and gaps --------------------------------------------------------------------------

SESS = "OVER (PARTITION BY symbol, session_date ORDER BY ts, seq)"


@query(
    "win_26",
    f"""WITH {ROUGH}, g AS (SELECT *, sum(CASE WHEN volume = 0 THEN 0 ELSE 1 END) {LAG} AS grp FROM rough),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, grp ORDER BY ts, seq) AS run FROM g)
SELECT symbol, seq, volume = 0 AND run > 5 AS is_stale FROM r""",
)
def _stale_volume(t):
    return on_series(t.rough(), clean.stale_by_volume()).select("symbol", "seq", "is_stale")


FROZEN = f"""same AS (SELECT *, coalesce({' AND '.join(f'{c} = lag({c}) {LAG}' for c in ('open', 'high', 'low', 'close'))}, false) AS same FROM rough),
grp AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) {LAG} AS grp FROM same),
runs AS (SELECT *, row_number() OVER (PARTITION BY symbol, grp ORDER BY ts, seq) AS run FROM grp)"""


@query("win_27", f"WITH {ROUGH}, {FROZEN} SELECT symbol, seq, same AND run >= 5 AS is_stale FROM runs")
def _stale_price(t):
    return on_series(t.rough(), clean.stale_by_price()).select("symbol", "seq", "is_stale")


@query("win_28", f"WITH {ROUGH}, {FROZEN} SELECT symbol, seq, coalesce(CASE WHEN seq % 9 > 1 THEN seq % 9 = 2 END, false) OR (same AND run >= 5) AS is_stale FROM runs")
def _stale_merge(t):
    s = F.col("seq") % 9
    df = t.rough().withColumn("fed", F.when(s > 1, s == 2))
    df = on_series(df, clean.stale_by_price(name="seen"))
    return df.select("symbol", "seq", clean.merge_stale("fed", "seen").alias("is_stale"))


@query(
    "win_29",
    sql(
        f"""{ROUGH}, n AS (SELECT *, row_number() {SESS} AS pos FROM rough),
k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY pos ROWS UNBOUNDED PRECEDING) AS la,
  last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lc,
  first_value(CASE WHEN close IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ra,
  first_value(close IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rc FROM n),
c AS (SELECT symbol, seq, open AS o, coalesce(close, CASE WHEN la IS NULL THEN rc WHEN ra IS NULL THEN lc ELSE lc + (rc - lc) * (pos - la) / (ra - la) END) AS close FROM k),
final AS (SELECT symbol, seq, coalesce(o, close) AS open, close FROM c)""",
        "symbol, seq",
        "open close",
    ),
)
def _gaps(t):
    return clean.fill_gaps(t.rough()).select("symbol", "seq", "open", "close")


# -- resampling ------------------------------------------------------------------------------------


@query(
    "agg_01",
    sql(
        f"""{TICKS}, final AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_max(price, (ts, seq)) AS price,
  max(high) AS high, min(low) AS low, sum(volume) AS volume FROM ticks GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts))""",
        "symbol, ts",
        "price high low volume",
    ),
)
def _resample(t):
    return resample(t.ticks(), "1 hour")


# -- sorts, set operations -------------------------------------------------------------------------


@query("top_01", f"WITH {TICKS} SELECT symbol, ts, seq FROM ticks ORDER BY ts, seq")
def _sorted(t):
    return t.ticks().select("symbol", "ts", "seq").orderBy("ts", "seq")


@query(
    "set_01",
    sql(
        f"""{BARS}, final AS (SELECT symbol, seq, close, CAST(NULL AS DOUBLE) AS volume FROM bars WHERE session_date < DATE '2024-01-16'
UNION ALL SELECT symbol, seq, close, volume FROM bars WHERE session_date >= DATE '2024-01-16')""",
        "symbol, seq",
        "close volume",
    ),
)
def _union_days(t):
    b = t.bars()
    early = b.where("session_date < DATE '2024-01-16'").select("symbol", "seq", "close")
    return early.unionByName(b.where("session_date >= DATE '2024-01-16'").select("symbol", "seq", "close", "volume"), allowMissingColumns=True)


SIDE = "CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END"


@query("set_02", f"SELECT p_partkey, {SIDE} AS option_type FROM part WHERE ({SIDE} = 'C' AND p_size > 25) OR ({SIDE} = 'P' AND p_size < 25)")
def _union_sides(t):
    df = t.raw("part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P").alias("option_type"))
    calls = df.where("option_type = 'C' AND p_size > 25")
    return calls.unionByName(df.where("option_type = 'P' AND p_size < 25")).select("p_partkey", "option_type")


@query("set_03", "SELECT event_type AS symbol, count(DISTINCT event_type) OVER () = 5 AS expected FROM (SELECT DISTINCT event_type FROM events)")
def _distinct(t):
    names = t.ticks().select("symbol").distinct()
    count = names.agg((F.count(F.lit(1)) == 5).alias("expected"))
    return names.crossJoin(F.broadcast(count))


@query("set_04", "SELECT DISTINCT p_brand AS symbol FROM part WHERE p_size > 45 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size < 3")
def _difference(t):
    p = t.raw("part")
    wanted = p.where("p_size > 45").select(F.col("p_brand").alias("symbol")).distinct()
    have = p.where("p_type = 'ECONOMY' AND p_size < 3").select(F.col("p_brand").alias("symbol"))
    return wanted.join(have, "symbol", "left_anti")


@query("set_05", "SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-16' INTERSECT SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def _intersection(t):
    e = t.raw("events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return e.where(early).select("user_id").intersect(e.where(~early).select("user_id"))


# -- scalar functions ------------------------------------------------------------------------------


@query(
    "fun_01",
    sql(
        """final AS (SELECT event_id, ln(value) AS ln_v, log2(value) AS log2_v, exp(-value / 100) AS exp_v, sqrt(value) AS sqrt_v,
  abs(value - 50) AS abs_v, sign(value - 50) AS sign_v, pow(value, 0.5e0) AS pow_v FROM events)""",
        "event_id",
        "ln_v log2_v exp_v sqrt_v abs_v sign_v pow_v",
    ),
)
def _math(t):
    v = F.col("value")
    return t.raw("events").select(
        "event_id",
        F.ln(v).alias("ln_v"),
        F.log2(v).alias("log2_v"),
        F.exp(-v / 100).alias("exp_v"),
        F.sqrt(v).alias("sqrt_v"),
        F.abs(v - 50).alias("abs_v"),
        F.signum(v - 50).cast("long").alias("sign_v"),
        F.pow(v, F.lit(0.5)).alias("pow_v"),
    )


@query(
    "fun_02",
    sql("final AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN greatest(least((value - 50) / 10, 3.5e0), -3.5e0) END AS z FROM events)", "event_id", "z"),
)
def _clip(t):
    z = F.when(F.col("event_id") % 5 > 0, (F.col("value") - 50) / 10)
    return t.raw("events").select("event_id", fn.clip(z, -3.5, 3.5).alias("z"))


@query("fun_03", sql("final AS (SELECT event_id, value / (user_id + 1e0) AS plus_one, value / (user_id + 1e-8) AS tiny FROM events)", "event_id", "plus_one tiny"))
def _ratio(t):
    v, u = F.col("value"), F.col("user_id")
    return t.raw("events").select("event_id", fn.ratio(v, u, 1.0).alias("plus_one"), fn.ratio(v, u, 1e-8).alias("tiny"))


@query(
    "fun_04",
    sql("final AS (SELECT event_id, event_id % 4 = 0 AS missing, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS filled, nullif(user_id % 3, 0) AS no_zero FROM events)", "event_id, missing, no_zero", "filled"),
)
def _nulls(t):
    x = F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value"))
    return t.raw("events").select(
        "event_id",
        fn.finite(x).isNull().alias("missing"),
        F.coalesce(fn.finite(x), F.lit(0.0)).alias("filled"),
        fn.blank_zero(F.col("user_id") % 3).alias("no_zero"),
    )


@query("fun_05", sql(f"{BARS}, final AS (SELECT symbol, seq, greatest(open, close, high) AS top, least(open, close, CASE WHEN seq % 3 = 0 THEN low END) AS bottom FROM bars)", "symbol, seq", "top bottom"))
def _extremes(t):
    low = F.when(F.col("seq") % 3 == 0, F.col("low"))
    return t.bars().select("symbol", "seq", F.greatest("open", "close", "high").alias("top"), F.least(F.col("open"), F.col("close"), low).alias("bottom"))


@query(
    "fun_06",
    """SELECT event_id, upper(event_type) AS up, contains(event_type, 'up') AS has_up, starts_with(event_type, 's') AS starts,
  suffix(event_type, 'k') AS ends, substr(event_type, 1, 3) AS head FROM events""",
)
def _text(t):
    c = F.col("event_type")
    return t.raw("events").select(
        "event_id", F.upper(c).alias("up"), c.contains("up").alias("has_up"), c.startswith("s").alias("starts"), c.endswith("k").alias("ends"), F.substring(c, 1, 3).alias("head")
    )


@query(
    "fun_07",
    """SELECT event_id, array_to_string(list_filter(list_transform(string_split(concat(event_type, ', ,', props, ' ,  x'), ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS names FROM events""",
)
def _names(t):
    text = F.concat("event_type", F.lit(", ,"), "props", F.lit(" ,  x"))
    return t.raw("events").select("event_id", F.array_join(fn.names_list(text), "|").alias("names"))


@query("fun_08", "SELECT event_id, ts + INTERVAL 330 MINUTE AS local_ts, ts - INTERVAL 330 MINUTE AS utc_ts FROM events")
def _zones(t):
    ts = F.col("ts").cast("timestamp_ntz")
    return t.raw("events").select("event_id", fn.exchange_wall(ts).alias("local_ts"), fn.from_exchange_wall(ts).alias("utc_ts"))


@query(
    "fun_09",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, isodow(o_orderdate) - 1 AS weekday,
  date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days_left, o_orderdate + INTERVAL 30 MINUTE AS embargo FROM orders""",
)
def _dates(t):
    d = F.col("o_orderdate").cast("timestamp_ntz")
    return t.raw("orders").select(
        "o_orderkey",
        F.to_date(d).alias("day"),
        fn.monday_weekday(d).alias("weekday"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date(d)).alias("days_left"),
        (d + F.expr("INTERVAL 30 MINUTES")).alias("embargo"),
    )


@query("fun_10", sql("final AS (SELECT event_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS single FROM events)", "event_id", "single"))
def _single(t):
    return t.raw("events").select("event_id", fn.through_float(F.col("value") / 3).alias("single"))


@query(
    "fun_13",
    """SELECT event_id, coalesce(json_extract_string(doc, '$.ltp'), json_extract_string(doc, '$.market_data.ltp'), json_extract_string(doc, '$.k')) AS px FROM
(SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"ltp": ' || user_id || '}' ELSE '{"market_data": {"ltp": ' || user_id || '}}' END AS doc FROM events)""",
)
def _json(t):
    u = F.col("user_id").cast("string")
    doc = (
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"ltp": '), u, F.lit("}")))
        .otherwise(F.concat(F.lit('{"market_data": {"ltp": '), u, F.lit("}}")))
    )
    return t.raw("events").select("event_id", fn.json_first(doc, "$.ltp", "$.market_data.ltp", "$.k").alias("px"))


@query(
    "fun_14",
    sql(
        """final AS (SELECT vec_id, list_max(embedding)::DOUBLE AS hi, list_min(embedding)::DOUBLE AS lo, list_sort(embedding)[3]::DOUBLE AS third,
  len(list_filter(embedding, lambda x: x > 0)) AS positive, list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) AS head_sum FROM embeddings)""",
        "vec_id, positive",
        "hi lo third head_sum",
    ),
)
def _arrays(t):
    e = F.col("embedding")
    return t.raw("embeddings").select(
        "vec_id",
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.array_max(e).alias("hi"),
        F.array_min(e).alias("lo"),
        F.get(F.array_sort(e), F.lit(2)).alias("third"),
        F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("head_sum"),
    )


@query(
    "fun_15",
    sql(
        """final AS (SELECT p_partkey, (p_size - 1) / 49e0 AS size_pos,
  CASE WHEN p_retailprice BETWEEN 900 AND 2000 THEN (ln(p_retailprice) - ln(900e0)) / (ln(2000e0) - ln(900e0)) END AS price_pos,
  CASE p_type WHEN 'ECONOMY' THEN 0e0 WHEN 'STANDARD' THEN 0.5e0 WHEN 'PROMO' THEN 1e0 END AS type_pos FROM part)""",
        "p_partkey",
        "size_pos price_pos type_pos",
    ),
)
def _positions(t):
    return t.raw("part").select(
        "p_partkey",
        fn.step_position(F.col("p_size"), 1, 50).alias("size_pos"),
        fn.rank_position(F.col("p_retailprice"), 900.0, 2000.0, log=True).alias("price_pos"),
        fn.choice_position(F.col("p_type"), ["ECONOMY", "STANDARD", "PROMO"]).alias("type_pos"),
    )


@query(
    "fun_16",
    sql(
        f"""{TICKS}, final AS (SELECT symbol, quantile_cont(price, 0.025) AS p025, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.975) AS p975 FROM ticks GROUP BY symbol)""",
        "symbol",
        "p025 p25 p975",
    ),
)
def _percentiles(t):
    p = F.percentile("price", [0.025, 0.25, 0.975])
    df = t.ticks().groupBy("symbol").agg(p.alias("_p"))
    return df.select("symbol", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p025", "p25", "p975"))])

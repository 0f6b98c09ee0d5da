"""Time alignment: session clocks, as-of and range joins, expiries, corporate actions, dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import exchange_wall, from_exchange_wall
from barloom.plans.steps import Step, on_series
from barloom.plans.timeline import Timeline
from barloom.schema import DEFAULT_REGIME, EXCHANGE_ZONE, SESSION_END, SESSION_START
from barloom.session import small_side


def session_clock(
    sessions: DataFrame, start: str = SESSION_START, end: str = SESSION_END, zone: str = EXCHANGE_ZONE, every: str = "1 minute"
) -> DataFrame:
    """One row per ``every`` of each session (columns of ``sessions`` plus ts in UTC wall time)."""
    first = F.to_timestamp_ntz(F.concat(F.col("session_date").cast("string"), F.lit(f" {start}:00")))
    last = F.to_timestamp_ntz(F.concat(F.col("session_date").cast("string"), F.lit(f" {end}:00")))
    local = F.explode(F.sequence(first, last, F.expr(f"INTERVAL {every}")))
    return sessions.withColumn("ts", local).withColumn("ts", from_exchange_wall(F.col("ts"), zone))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    on: str = "ts",
    right_order: Sequence[str] = ("seq",),
    tolerance: str | None = None,
    exact: bool = True,
    matched: str = "matched_ts",
) -> DataFrame:
    """Attach to every left row the latest right row at or before it (``exact=False``: strictly before).

    Both sides are stacked and swept once in time order, so the cost is one shuffle and linear, also where
    a key is hot; a non-equi join would compare all pairs of a key.
    """
    extra = [c for c in left.columns if c not in (*keys, on)]
    rank = F.lit(1 if exact else -1)
    l = left.select(*keys, on, rank.alias("_side"), F.struct(*extra).alias("_l") if extra else F.lit(True).alias("_l"))
    l = l.withColumn("_id", F.monotonically_increasing_id())
    payload = F.struct(F.col(on).alias(matched), *values)
    r = right.select(*keys, on, F.lit(0).alias("_side"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(right_order)], payload.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = [on, "_side", *[f"_r{i}" for i in range(len(right_order))], "_id"]
    swept = on_series(both, [], keys, order, running={"_hit": ("last", F.col("_r"))}).where("_side <> 0")
    hit = F.col("_hit")
    if tolerance:
        hit = F.when(F.col(f"_hit.{matched}") >= F.col(on) - F.expr(f"INTERVAL {tolerance}"), hit)
    swept = swept.withColumn("_hit", hit)
    return swept.select(
        *keys, on, *[F.col(f"_l.{c}").alias(c) for c in extra], F.col(f"_hit.{matched}"), *[F.col(f"_hit.{c}") for c in values]
    )


def bounded_fill(limit: int = 5) -> Step:
    """Carry a close for at most ``limit`` rows; missing prices take the close, missing volume is zero."""

    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"close": F.last("close", ignorenulls=True).over(tl.over(-limit, 0))})
        tl = tl.add({c: F.coalesce(F.col(c), F.col("close")) for c in ("open", "high", "low")})
        return tl.add({"volume": F.coalesce(F.col("volume"), F.lit(0.0))})

    return Step(run, back=limit)


def align_to_clock(clock: DataFrame, bars: DataFrame, tolerance: str = "60 SECONDS", limit: int = 5) -> DataFrame:
    """Clock rows with the bar of the last minute, then the bounded fill within each session."""
    joined = asof_join(clock, bars, ["open", "high", "low", "close", "volume"], tolerance=tolerance)
    return on_series(joined, bounded_fill(limit), ("symbol", "session_date"), ("ts",)).drop("matched_ts")


def to_wide(df: DataFrame, symbols: Sequence[str], cols: Sequence[str], key: str = "ts") -> DataFrame:
    """Wide export: ``<symbol>_<column>`` per instrument of a bounded list."""
    wide = df.groupBy(key).pivot("symbol", list(symbols)).agg(*[F.first(c).alias(c) for c in cols])
    return wide.withColumnRenamed(f"{key}", key)


# -- calendars and regimes -------------------------------------------------------------------------


def attach_regime(df: DataFrame, regimes: DataFrame, on: str = "session_date") -> DataFrame:
    """Regime whose [date_from, date_to] holds the session date: the first in table order, else the default.

    Only the distinct dates meet the ranges; the rows then join on the date.
    """
    dates = df.select(on).distinct()
    inside = F.col(on).between(F.col("date_from"), F.col("date_to"))
    hit = dates.join(small_side(regimes), inside, "left").groupBy(on).agg(
        F.min_by(F.struct("expiry_weekday", "regime_flag"), F.col("date_from")).alias("_g")
    )
    hit = hit.select(
        on,
        F.coalesce(F.col("_g.expiry_weekday"), F.lit(DEFAULT_REGIME[2])).alias("expiry_weekday"),
        F.coalesce(F.col("_g.regime_flag"), F.lit(DEFAULT_REGIME[3])).alias("regime_flag"),
    )
    return df.join(small_side(hit), on)


def next_expiry(dates: DataFrame, sessions: DataFrame, horizon: int = 20) -> DataFrame:
    """First trading session on the regime weekday within ``horizon`` days (session_date, expiry_weekday in)."""
    ahead = F.explode(F.sequence(F.col("session_date"), F.date_add("session_date", horizon)))
    wanted = dates.select("session_date", "expiry_weekday", ahead.alias("_day")).where(
        F.weekday("_day") == F.col("expiry_weekday")
    )
    open_days = sessions.select(F.col("session_date").alias("_day")).distinct()
    found = wanted.join(open_days, "_day").groupBy("session_date", "expiry_weekday").agg(F.min("_day").alias("expiry_date"))
    return dates.join(found, ["session_date", "expiry_weekday"], "left")


def expiry_features(df: DataFrame, regimes: DataFrame, sessions: DataFrame, horizon: int = 20) -> DataFrame:
    """Days to the next expiry, the same in weeks, expiry-day and regime flags per row."""
    days = attach_regime(df.select("session_date").distinct(), regimes)
    days = next_expiry(days, sessions, horizon)
    left = F.datediff("expiry_date", "session_date")
    days = days.select(
        "session_date",
        left.cast("double").alias("days_to_expiry"),
        (left / 7.0).alias("dte_normalized"),
        F.coalesce(F.col("session_date") == F.col("expiry_date"), F.lit(False)).alias("is_expiry_day"),
        F.when(F.col("expiry_date").isNotNull(), F.col("regime_flag")).otherwise(F.lit(0)).alias("regime_flag"),
    )
    return df.join(small_side(days), "session_date")


# -- corporate actions -----------------------------------------------------------------------------


def _action_spans(actions: DataFrame) -> DataFrame:
    """Events per symbol in ex-date order with the span of dates since the event before."""
    order = Step(
        lambda tl: tl.add(
            {"event_no": tl.pos, "span_from": F.coalesce(F.lag("ex_date", 1).over(tl.over()), F.lit("0001-01-01").cast("date"))}
        ),
        back=1,
    )
    return on_series(actions.dropDuplicates(["symbol", "ex_date"]), order, order=("ex_date",))


def _in_span(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Each bar before the last event meets exactly one span, so the join never multiplies bars."""
    b, s = bars.alias("b"), small_side(spans).alias("s")
    cond = (
        (F.col("b.symbol") == F.col("s.symbol"))
        & (F.col("b.session_date") < F.col("s.ex_date"))
        & (F.col("b.session_date") >= F.col("s.span_from"))
    )
    return b.join(s, cond, "left")


def action_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Price and volume factors per span of dates.

    Splits scale everything before their ex-date.  A dividend scales it by (close - dividend) / close, with
    the last close before the ex-date as adjusted by the events handled so far.  Products over events are running
    sums, so a symbol may have any number of events.
    """
    spans = _action_spans(actions)
    last = (
        _in_span(bars.where(F.col("close").isNotNull()).select("symbol", "session_date", "ts", "close"), spans)
        .where(F.col("s.event_no").isNotNull())
        .groupBy(F.col("s.symbol").alias("symbol"), F.col("s.event_no").alias("event_no"))
        .agg(F.max_by(F.struct("b.session_date", "b.close"), F.col("b.ts")).alias("_seen"))
    )
    events = on_series(
        spans.join(last, ["symbol", "event_no"], "left"),
        [],
        order=("event_no",),
        running={"_prior": ("last", F.col("_seen"))},
    )
    own = F.coalesce(1.0 / F.when((F.col("split_ratio") > 0) & (F.col("split_ratio") != 1.0), F.col("split_ratio")), F.lit(1.0))
    paid = F.when(F.col("dividend_amount") > 0, F.col("dividend_amount"))
    events = events.select("symbol", "event_no", "ex_date", "span_from", own.alias("_own"), paid.alias("_paid"), "_prior.session_date", "_prior.close")
    # Events without a close between them share the close before: with A the close as adjusted so far, each turns A into
    # own * A - dividend. Divided by the running product of ``own`` that is a running sum.
    events = on_series(events, [], ("symbol", "session_date"), ("event_no",), running={"_ln": ("sum", F.ln("_own"))})
    events = events.withColumn("_term", F.coalesce(F.col("_paid") * F.exp(-F.col("_ln")), F.lit(0.0)))
    events = on_series(events, [], ("symbol", "session_date"), ("event_no",), running={"_terms": ("sum", F.col("_term"))})
    left = F.col("close") - (F.col("_terms") - F.col("_term"))
    px = left * F.exp("_ln")
    cut = F.when((left > 0) & F.col("_paid").isNotNull(), (px - F.col("_paid")) / px).otherwise(F.lit(1.0))
    events = events.select("symbol", "event_no", "ex_date", "span_from", (F.col("_own") * cut).alias("_px"), (-F.ln("_own")).alias("_ln_vol"))
    # A span's factor is the product over this event and all later ones.
    size = F.when(F.col("_px") != 0, F.ln(F.abs("_px")))
    later = {
        "_ln": ("sum", size),
        "_none": ("sum", (F.col("_px") == 0).cast("long")),
        "_minus": ("sum", (F.col("_px") < 0).cast("long")),
        "_vol": ("sum", F.col("_ln_vol")),
    }
    tails = on_series(events.withColumn("_back", -F.col("event_no")), [], order=("_back",), running=later)
    sign = F.when(F.col("_minus") % 2 == 1, -1.0).otherwise(1.0)
    factor = F.when(F.col("_none") > 0, 0.0).otherwise(sign * F.exp(F.coalesce("_ln", F.lit(0.0))))
    return tails.select("symbol", "ex_date", "span_from", factor.alias("px_factor"), F.exp("_vol").alias("vol_factor"))


def adjust_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Back-adjusted bars over the full history (symbol, session_date, ts, OHLC, volume)."""
    out = _in_span(bars, action_factors(bars, actions))
    px, vol = F.coalesce("s.px_factor", F.lit(1.0)), F.coalesce("s.vol_factor", F.lit(1.0))
    scaled = {c: F.col(f"b.{c}") * px for c in ("open", "high", "low", "close")} | {"volume": F.col("b.volume") * vol}
    return out.select(*[scaled.get(c, F.col(f"b.{c}")).alias(c) for c in bars.columns], px.alias("px_factor"), vol.alias("vol_factor"))


# -- dimensions ------------------------------------------------------------------------------------


def instrument_keys(df: DataFrame, instruments: DataFrame, segment: str = "BSE_EQ") -> DataFrame:
    """Instrument key by upper-cased symbol and segment, else a key built from them."""
    dim = instruments.select(
        F.upper("trading_symbol").alias("_sym"), F.upper("segment").alias("_seg"), F.col("instrument_key").alias("_key")
    ).where(F.col("_seg") == segment.upper())
    dim = dim.groupBy("_sym").agg(F.min("_key").alias("_key"))
    out = df.join(small_side(dim), F.upper("symbol") == F.col("_sym"), "left")
    built = F.concat(F.lit(f"{segment}|"), F.upper("symbol"))
    return out.withColumn("instrument_key", F.coalesce("_key", built)).drop("_sym", "_key")


def attach_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight and sector of the constituents that occur in the data, weights scaled to sum to one."""
    present = df.select("symbol").distinct()
    dim = weights.join(present, "symbol", "left_semi")
    total = dim.agg(F.sum("weight").alias("_total"))
    dim = dim.crossJoin(F.broadcast(total)).select(
        "symbol", "sector", F.when(F.col("_total") != 0, F.col("weight") / F.col("_total")).otherwise(F.col("weight")).alias("weight")
    )
    return df.join(small_side(dim), "symbol")


def attach_first(df: DataFrame, features: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join of the first feature row per key; columns that already exist are replaced."""
    rest = [c for c in features.columns if c not in (*on, *order)]
    one = features.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*on, "_f.*")
    return df.drop(*rest).join(one, list(on), "left")


def missing_days(wanted: DataFrame, present: DataFrame, on: Sequence[str] = ("session_date",)) -> DataFrame:
    return wanted.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def local_day(ts: str = "ts", zone: str = EXCHANGE_ZONE) -> Column:
    return F.to_date(exchange_wall(F.col(ts), zone))

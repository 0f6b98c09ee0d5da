"""Cleaning: coercion, validity, first-per-key, bar integrity, stale feeds, gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import exchange_wall, finite, number
from barloom.plans.steps import SERIES, TICK_ORDER, Step, on_series
from barloom.plans.timeline import Timeline
from barloom.schema import EPSILON, EXCHANGE_ZONE, SESSION_END, SESSION_START, TICK_ALIASES

SESSION = ("symbol", "session_date")


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = TICK_ALIASES) -> DataFrame:
    """Rename known source columns unless the target already exists."""
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in have and b not in have})


def coerce_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in cols})


def valid_ticks(df: DataFrame) -> DataFrame:
    """Complete ticks with positive prices, a volume of at least zero and high not below low."""
    p, h, lo, v = (F.col(c) for c in ("price", "high", "low", "volume"))
    return df.where((p > 0) & (h > 0) & (lo > 0) & (v >= 0) & (h >= lo) & F.col("ts").isNotNull())


def first_per(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the first row per key; partial aggregation keeps a heavily repeated key small before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def row_accounting(df: DataFrame, keep: Column, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows at the start, kept and dropped by a filter."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("start_rows"), kept.alias("kept_rows"), (F.count(F.lit(1)) - kept).alias("dropped_rows")
    )


def session_hours(df: DataFrame, start: str = SESSION_START, end: str = SESSION_END, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Rows inside the local session, both minutes included, with the local date."""
    local = exchange_wall(F.col("ts"), zone)
    clock = F.date_format(local, "HH:mm:ss")
    return df.where(clock.between(f"{start}:00", f"{end}:00")).withColumn("session_date", F.to_date(local))


def session_index(df: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """0-based bar number within each session."""
    return on_series(df, Step(lambda tl: tl.add({"bar_index": tl.pos})), keys, order)


def quarantine(limit: float = 0.20) -> Step:
    """Flag impossible bars and blank their prices; a jump against the previous bar also counts."""

    def run(tl: Timeline) -> Timeline:
        o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
        before = F.lag("close", 1).over(tl.over())
        jump = F.abs(F.ln((c + EPSILON) / (before + EPSILON)))
        bad = (
            (h < F.greatest(o, c))
            | (lo > F.least(o, c))
            | (o <= 0)
            | (h <= 0)
            | (lo <= 0)
            | (c <= 0)
            | (v < 0)
            | (F.coalesce(jump, F.lit(0.0)) >= limit)
        )
        tl = tl.add({"is_invalid_bar": F.coalesce(bad, F.lit(False))})
        return tl.add({x: F.when(~F.col("is_invalid_bar"), F.col(x)) for x in ("open", "high", "low", "close")})

    return Step(run, back=1)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite values become null, then rows with a null in ``cols`` go."""
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in cols}).na.drop(subset=list(cols))


def narrow(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sink types: FLOAT numbers, INT volumes, SHORT bar index, BYTE flags; ``keep`` names stay as they are."""
    kinds = {T.DoubleType: "float", T.LongType: "tinyint", T.IntegerType: "tinyint", T.BooleanType: "boolean"}
    out = []
    for f in df.schema.fields:
        want = None if f.name in keep else kinds.get(type(f.dataType))
        if f.name.endswith("volume") and f.name not in keep:
            want = "int"
        elif f.name.startswith("bar_index"):
            want = "smallint"
        out.append(F.col(f.name).try_cast(want).alias(f.name) if want else F.col(f.name))
    return df.select(*out)


def project(df: DataFrame, keys: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Keys plus the wanted columns; an absent one comes as a typed null."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in wanted])


def fill_forward(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = SERIES, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Last known value, and zero before the first one."""
    filled = on_series(df, [], keys, order, running={f"_f_{c}": ("last", F.col(c)) for c in cols})
    filled = filled.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) for c in cols})
    return filled.drop(*[f"_f_{c}" for c in cols])


def sides_to_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("iv", "delta", "gamma", "vega", "vol", "oi")) -> DataFrame:
    """Wide option rows (ce_*, pe_*) to one row per side."""
    calls, puts = ", ".join(f"ce_{f}" for f in fields), ", ".join(f"pe_{f}" for f in fields)
    names = ", ".join(["option_type", *fields])
    return df.select(*keys, F.expr(f"stack(2, 'C', {calls}, 'P', {puts}) AS ({names})"))


# -- stale feeds and gaps --------------------------------------------------------------------------


def stale_by_volume(limit: int = 5, name: str = "is_stale") -> Step:
    """No volume for ``limit`` rows in a row; a series that starts silent needs one row more."""

    def run(tl: Timeline) -> Timeline:
        silent = (F.coalesce(F.col("volume"), F.lit(0)) == 0).cast("int")
        return tl.add({name: (F.sum(silent).over(tl.over(-(limit - 1), 0)) == limit) & (tl.pos >= limit)})

    return Step(run, back=limit)


def stale_by_price(run_rows: int = 5, name: str = "is_stale") -> Step:
    """The same open, high, low and close as the row before, for a run of ``run_rows`` bars."""

    def run(tl: Timeline) -> Timeline:
        same = F.lit(True)
        for c in ("open", "high", "low", "close"):
            same = same & (F.col(c) == F.lag(c, 1).over(tl.over()))
        tl = tl.add({"_same": F.coalesce(same, F.lit(False)).cast("int")})
        repeats = run_rows - 1
        return tl.add({name: F.sum("_same").over(tl.over(-(repeats - 1), 0)) == repeats})._drop("_same")

    return Step(run, back=run_rows)


def merge_stale(existing: str, detected: str) -> Column:
    return F.coalesce(F.col(existing), F.lit(False)) | F.coalesce(F.col(detected), F.lit(False))


def fill_gaps(df: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Closes by linear interpolation on the bar number inside a session, flat at both ends."""
    known = F.when(F.col("close").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("close").alias("px")))
    numbered = on_series(df, Step(lambda tl: tl.add({"_at": tl.pos})), keys, order)
    out = on_series(numbered, [], keys, order, running={"_l": ("last", known), "_r": ("next", known)})
    left, right = F.col("_l.px"), F.col("_r.px")
    share = F.try_divide(F.col("_at") - F.col("_l.at"), F.col("_r.at") - F.col("_l.at"))
    close = (
        F.when(F.col("close").isNotNull(), F.col("close"))
        .when(left.isNull(), right)
        .when(right.isNull(), left)
        .otherwise(left + (right - left) * share)
    )
    out = out.withColumn("close", close)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col("close")) for c in ("open", "high", "low")})
    return out.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0))).drop("_at", "_l", "_r")

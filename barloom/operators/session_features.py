"""Features that restart with each session, forward targets, and equity-curve series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import clip
from barloom.operators.indicators import span_alpha, true_range
from barloom.plans.steps import SERIES, TICK_ORDER, Step, full, on_series
from barloom.plans.timeline import Timeline, lay_out
from barloom.schema import ANNUAL_BARS, ATR_WINDOW, EPSILON, Z_CLIP, Z_WINDOW
from barloom.session import small_side

SESSION = ("symbol", "session_date")


# -- returns ---------------------------------------------------------------------------------------


def log_return(close: str = "close", name: str = "log_ret") -> Step:
    """Log return against the previous bar of the series; null on its first bar."""

    def run(tl: Timeline) -> Timeline:
        return tl.add({name: F.ln((F.col(close) + EPSILON) / (F.lag(close, 1).over(tl.over()) + EPSILON))})

    return Step(run, back=1)


def overnight_return(df: DataFrame, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """First close against the last close of the session before, repeated over the session.

    The sessions are reduced to two closes each before anything is ordered.
    """
    at = F.struct(*order)
    ends = df.groupBy(*SESSION).agg(F.min_by("close", at).alias("_first"), F.max_by("close", at).alias("_last"))

    def run(tl: Timeline) -> Timeline:
        before = F.lag("_last", 1).over(tl.over())
        step = F.when((before > 0) & (F.col("_first") > 0), F.ln((F.col("_first") + EPSILON) / (before + EPSILON)))
        return tl.add({"overnight_ret": step})

    nights = on_series(ends, Step(run, back=1), SERIES, ("session_date",)).select(*SESSION, "overnight_ret")
    return df.join(small_side(nights), list(SESSION))


# -- rolling inside the session --------------------------------------------------------------------


def volume_zscore(n: int = Z_WINDOW, need: int = 5, name: str = "vol_zscore") -> Step:
    def run(tl: Timeline) -> Timeline:
        v = F.col("volume")
        mean, dev = full(tl, F.avg, v, n, need), full(tl, F.stddev_samp, v, n, need)
        return tl.add({name: F.when(dev.isNotNull(), clip((v - mean) / F.greatest(dev, F.lit(EPSILON)), -Z_CLIP, Z_CLIP))})

    return Step(run, back=n)


def realised_vol(ns: Sequence[int] = (5, 30), r: str = "log_ret", scale: float = ANNUAL_BARS) -> Step:
    def run(tl: Timeline) -> Timeline:
        x = F.coalesce(F.col(r), F.lit(0.0))
        return tl.add({f"rv_{n}": F.sqrt(F.sum(x * x).over(tl.over(-(n - 1), 0)) * F.lit(scale)) for n in ns})

    return Step(run, back=max(ns))


def vol_of_vol(n: int = 12, need: int = 2, fast: int = 5, r: str = "log_ret") -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = realised_vol((fast,), r).run(tl)
        return tl.add({"vov": full(tl, F.stddev_samp, F.col(f"rv_{fast}"), n, need)})

    return Step(run, back=n + fast)


def momentum_sums(r: str = "log_ret", ns: Sequence[int] = (5, 15, 30)) -> Step:
    """Return sums and the decay of the short against the middle one."""

    def run(tl: Timeline) -> Timeline:
        x = F.coalesce(F.col(r), F.lit(0.0))
        tl = tl.add({f"m_{n}": F.sum(x).over(tl.over(-(n - 1), 0)) for n in ns})
        fast, mid = F.col(f"m_{ns[0]}"), F.col(f"m_{ns[1]}")
        return tl.add({"mds": (fast - mid) / (F.abs(mid) + EPSILON)})

    return Step(run, back=max(ns))


def vwap_deviation(df: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = TICK_ORDER) -> DataFrame:
    """Distance of the close from the session VWAP in units of the average true range."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0

    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"_tr": true_range(tl, "close")})
        tl = tl.ewm({"_atr": (F.col("_tr"), 1.0 / ATR_WINDOW, 0)})
        vwap = F.col("_pv") / F.greatest(F.col("_v"), F.lit(1.0))
        return tl.add({"vwap_dev": (F.col("close") - vwap) / F.greatest(F.col("_atr"), F.lit(EPSILON))})

    sums = {"_pv": ("sum", typical * F.col("volume")), "_v": ("sum", F.col("volume"))}
    return on_series(df, Step(run, back=1, watch=("close", "high", "low")), keys, order, running=sums, drop=("_pv", "_v", "_tr", "_atr"))


def session_zscore(
    df: DataFrame,
    cols: Sequence[str],
    n: int = Z_WINDOW,
    keys: Sequence[str] = SESSION,
    order: Sequence[str] = TICK_ORDER,
    stats: bool = False,
) -> DataFrame:
    """Rolling z-score inside the session; until enough values are in the window, all earlier ones are used.

    The expanding part needs running sums only (values, squares, count), which also work in chunks. They are taken over the
    distance from the first value of the group, so that a high level with a small spread keeps its digits.
    """
    need = max(20, n // 3)
    firsts = df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_f_{c}") for c in cols])
    df = df.join(firsts, list(keys), "left") if keys else df.crossJoin(firsts)  # one row
    running = {}
    for c in cols:
        x = F.col(c) - F.col(f"_f_{c}")
        running |= {f"_s_{c}": ("sum", x), f"_q_{c}": ("sum", x * x), f"_n_{c}": ("count", x)}

    def run(tl: Timeline) -> Timeline:
        out = {}
        for c in cols:
            s, q, k = F.col(f"_s_{c}"), F.col(f"_q_{c}"), F.col(f"_n_{c}")
            enough = F.when(k >= 2, True)
            mean = F.when(enough, F.try_divide(s, k) + F.col(f"_f_{c}"))
            spread = F.try_divide(q - F.try_divide(s * s, k), k - 1)
            dev = F.when(enough, F.sqrt(F.greatest(spread, F.lit(0.0))))
            out[f"_m_{c}"] = F.coalesce(full(tl, F.avg, F.col(c), n, need), mean)
            out[f"_d_{c}"] = F.coalesce(full(tl, F.stddev_samp, F.col(c), n, need), dev)
        tl = tl.add(out)
        done = {}
        for c in cols:
            dev = F.when(F.col(f"_d_{c}").isNotNull(), F.greatest(F.col(f"_d_{c}"), F.lit(1e-6)))
            done[f"{c}_z"] = clip((F.col(c) - F.col(f"_m_{c}")) / dev, -Z_CLIP, Z_CLIP)
            if stats:
                done |= {f"{c}_mu": F.col(f"_m_{c}"), f"{c}_std": dev}
        return tl.add(done)._drop(*[f"{p}{c}" for c in cols for p in ("_s_", "_q_", "_n_", "_m_", "_d_", "_f_")])

    return on_series(df, Step(run, back=n), keys, order, running=running)


# -- targets ---------------------------------------------------------------------------------------


def direction_target(r: str = "log_ret", name: str = "target") -> Step:
    """1 when the next return is positive, else 0 (also when it is missing); null on the last bar."""

    def run(tl: Timeline) -> Timeline:
        last = F.lead(F.lit(1), 1).over(tl.over()).isNull()
        up = F.coalesce(F.lead(r, 1).over(tl.over()) > 0, F.lit(False))
        return tl.add({name: F.when(~last, up.cast("int"))})

    return Step(run, back=0, ahead=1)


def drop_last_bar(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(F.col(target).isNotNull())


def signed_range_target(h: int = 5, x: str = "price", name: str = "target") -> Step:
    """Range of the next ``h`` prices, signed by their mean against the price, as a share of the price."""

    def run(tl: Timeline) -> Timeline:
        p, w = F.col(x), tl.over(1, h)
        size = F.max(x).over(w) - F.min(x).over(w)
        side = F.signum(F.avg(x).over(w) - p)
        return tl.add({name: F.when(F.count(x).over(w) == h, size * side / F.greatest(F.abs(p), F.lit(1e-8)))})

    return Step(run, back=0, ahead=h)


# -- smoothing of per-timestamp series -------------------------------------------------------------


def ema_over_time(df: DataFrame, cols: dict[str, str], span: int = 5, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Exponential means of per-timestamp columns, ``{new name: column}``."""
    step = Step(lambda tl: tl.ewm({n: (F.col(c), span_alpha(span), 0) for n, c in cols.items()}), watch=tuple(cols.values()))
    return on_series(df, step, keys, order)


def open_interest_flow(df: DataFrame, span: int = 5, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Imbalance of the levels and of their changes (call_oi, put_oi), smoothed."""

    def run(tl: Timeline) -> Timeline:
        c, p, zero = F.col("call_oi"), F.col("put_oi"), F.lit(0.0)
        dc = F.coalesce(c - F.lag("call_oi", 1).over(tl.over()), zero)
        dp = F.coalesce(p - F.lag("put_oi", 1).over(tl.over()), zero)
        tl = tl.add({"_imb": (c - p) / (c + p + 1.0), "_flow": (dc - dp) / (F.abs(dc) + F.abs(dp) + 1.0)})
        a = span_alpha(span)
        return tl.ewm({"oi_imbalance": (F.col("_imb"), a, 0), "oi_flow": (F.col("_flow"), a, 0)})._drop("_imb", "_flow")

    return on_series(df, Step(run, back=1, watch=("call_oi", "put_oi")), keys, order)


# -- panels ----------------------------------------------------------------------------------------


def fill_panel(panel: DataFrame, symbols: Sequence[str], price: str = "price") -> DataFrame:
    """Every listed symbol at every timestamp, forward then backward filled."""
    grid = panel.select("ts").distinct().withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols])))
    seen = panel.groupBy("ts", "symbol").agg(F.last(price, ignorenulls=True).alias(price))
    joined = grid.join(seen, ["ts", "symbol"], "left")
    out = on_series(joined, [], SERIES, ("ts",), running={"_p": ("last", F.col(price)), "_n": ("next", F.col(price))})
    return out.select("ts", "symbol", F.coalesce("_p", "_n").alias(price))


def panel_returns(filled: DataFrame, price: str = "price") -> DataFrame:
    """Log returns of a filled panel, without the first timestamp."""

    def run(tl: Timeline) -> Timeline:
        before = F.lag(price, 1).over(tl.over())
        return tl.add({"ret": F.ln(F.col(price) / F.greatest(before, F.lit(1e-8))), "_first": tl.pos == 0})

    return on_series(filled, Step(run, back=1), SERIES, ("ts",)).where(~F.col("_first")).drop("_first")


def forward_index_return(filled: DataFrame, h: int = 1, price: str = "price") -> DataFrame:
    """Log change of the mean price over ``h`` timestamps, the end held at the last one."""
    index = filled.groupBy("ts").agg(F.ln(F.avg(price)).alias("log_index"))
    last = index.agg(F.max_by("log_index", "ts").alias("_last"))

    def run(tl: Timeline) -> Timeline:
        return tl.add({"_ahead": F.lead("log_index", h).over(tl.over()), "row_no": tl.pos})

    out = on_series(index, Step(run, ahead=h), (), ("ts",)).where("row_no > 0").crossJoin(F.broadcast(last))
    return out.select("ts", "row_no", "log_index", (F.coalesce("_ahead", "_last") - F.col("log_index")).alias("target"))


# -- equity curves ---------------------------------------------------------------------------------


def drawdowns(df: DataFrame, pnl: str = "pnl", keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Running equity (summed and compounded), their peaks and drawdowns."""
    r = F.col(pnl)
    tl = lay_out(df, keys, order).running(
        {
            "equity": ("sum", r),
            "_log": ("sum", F.ln(F.abs(F.when(r != -1.0, 1.0 + r)))),
            "_neg": ("count", F.when(r < -1.0, 1)),
            "_zero": ("count", F.when(r == -1.0, 1)),
        }
    )
    sign = F.when(F.col("_zero") > 0, 0.0).when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    tl = tl.add({"growth": sign * F.exp(F.coalesce(F.col("_log"), F.lit(0.0)))})
    tl = tl.running({"peak": ("max", F.col("equity")), "growth_peak": ("max", F.col("growth"))})
    tl = tl.add(
        {
            "drawdown": F.col("equity") - F.col("peak"),
            "drawdown_ratio": 1.0 - F.col("growth") / F.greatest(F.col("growth_peak"), F.lit(1e-12)),
        }
    )
    return tl.finish("_log", "_neg", "_zero")


def losing_runs(df: DataFrame, pnl: str = "pnl", keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Length of the losing run that each row ends (0 on a row without a loss)."""
    tl = lay_out(df, keys, order)
    loss = F.col(pnl) < 0
    tl = tl.running({"_kept": ("last", F.when(~F.coalesce(loss, F.lit(False)), tl.pos))})
    run = F.when(loss, tl.pos - F.coalesce(F.col("_kept"), F.lit(-1))).otherwise(F.lit(0))
    return tl.add({"losing_run": run}).finish("_kept")


def previous_value_hits(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Whether prediction and actual lie on the same side of the previous actual."""

    def run(tl: Timeline) -> Timeline:
        before = F.lag(y, 1).over(tl.over())
        return tl.add({"hit": (F.signum(F.col(y) - before) == F.signum(F.col(p) - before)).cast("int")})

    return on_series(df, Step(run, back=1), keys, order)


def premium(iv: str = "atm_iv", rv: str = "rv_30") -> Column:
    """Volatility risk premium."""
    return F.col(iv) - F.col(rv)

"""Technical indicators over tick or bar series (columns price, high, low, volume)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.steps import SERIES, TICK_ORDER, Mean, Recurrence, Step, col, full, on_series, prepare, sweep
from barloom.plans.timeline import Timeline

EPS = 1e-12

# The feature schema contract (names and order).
BASE_FEATURES = (
    "price high low volume sma_14 sma_50 ema_12 ema_26 rsi_14 macd macd_signal macd_hist atr_14 "
    "bb_mid bb_upper bb_lower bb_width bb_pct_b parkinson_vol kc_upper kc_mid kc_lower "
    "vwap_20 obv cmf_20 tick_intensity adx plus_di minus_di ret_1 ret_5 ret_20 momentum_10 momentum_30 "
    "price_sma_ratio vol_z_20 kalman_price price_kalman_ratio entropy_20"
).split()
STOCH_FEATURES = ["stoch_rsi", "stoch_rsi_k", "stoch_rsi_d"]


def feature_names(stochastic: bool = True) -> list[str]:
    return BASE_FEATURES + STOCH_FEATURES if stochastic else list(BASE_FEATURES)


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1.0)


# -- moving averages -------------------------------------------------------------------------------


def sma(x: str, n: int, name: str) -> Step:
    return Step(lambda tl: tl.add({name: full(tl, F.avg, col(x), n)}), back=n)


def rolling_stats(xs: list[str], ns: list[int]) -> Step:
    """Rolling mean and sample deviation for several columns and lengths in one window pass."""

    def run(tl: Timeline) -> Timeline:
        out = {}
        for x in xs:
            for n in ns:
                out[f"{x}_mean_{n}"] = full(tl, F.avg, F.col(x), n)
                out[f"{x}_std_{n}"] = full(tl, F.stddev_samp, F.col(x), n)
        return tl.add(out)

    return Step(run, back=max(ns))


def lags(xs: list[str], ns: list[int]) -> Step:
    return Step(lambda tl: tl.add({f"{x}_lag_{n}": F.lag(x, n).over(tl.over()) for x in xs for n in ns}), back=max(ns))


def ema_part(x: str, n: int, name: str, start: int = 0) -> Recurrence:
    return Recurrence(spec=lambda tl: {name: Mean(col(x), span_alpha(n), start, n)})


def ema(x: str, n: int, name: str) -> Step:
    return Step(lambda tl: sweep(tl, [ema_part(x, n, name)]), watch=(x,), unbounded=True)


def warm_mean(x: str, n: int, name: str) -> Step:
    """Rolling mean whose warm-up rows show the raw value."""
    return Step(lambda tl: tl.add({name: F.coalesce(full(tl, F.avg, col(x), n), col(x))}), back=n)


# -- oscillators -----------------------------------------------------------------------------------


def rsi_part(x: str, n: int, name: str) -> Recurrence:
    zero, move = F.lit(0.0), F.col("_move")
    return Recurrence(
        before=lambda tl: {"_move": col(x) - F.lag(x, 1).over(tl.over())},
        spec=lambda tl: {
            "_gain": Mean(F.when(move.isNotNull(), F.greatest(move, zero)), 1.0 / n, 1, n),
            "_loss": Mean(F.when(move.isNotNull(), F.greatest(-move, zero)), 1.0 / n, 1, n),
        },
        after=lambda tl: {name: 100.0 - 100.0 / (1.0 + F.col("_gain") / (F.col("_loss") + EPS))},
    )


RSI_SCRATCH = ("_move", "_gain", "_loss")


def rsi(x: str, n: int, name: str) -> Step:
    return Step(lambda tl: sweep(tl, [rsi_part(x, n, name)])._drop(*RSI_SCRATCH), back=1, watch=(x,), unbounded=True)


def macd(x: str = "price", fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = sweep(tl, [ema_part(x, fast, "_fast"), ema_part(x, slow, "_slow")])
        tl = tl.add({"macd": F.col("_fast") - F.col("_slow")})
        tl = sweep(tl, [ema_part("macd", signal, "macd_signal", max(fast, slow) - 1)])
        return tl.add({"macd_hist": F.col("macd") - F.col("macd_signal")})._drop("_fast", "_slow")

    return Step(run, watch=(x,), unbounded=True)


def _stochastic(tl: Timeline, x: str, n: int, k: int, d: int) -> Timeline:
    lo, hi = full(tl, F.min, F.col(x), n), full(tl, F.max, F.col(x), n)
    tl = tl.add({"stoch_rsi": (F.col(x) - lo) / (hi - lo + EPS)})
    tl = tl.add({"stoch_rsi_k": full(tl, F.avg, F.col("stoch_rsi"), k)})
    return tl.add({"stoch_rsi_d": full(tl, F.avg, F.col("stoch_rsi_k"), d)})


def stoch_rsi(x: str = "price", n: int = 14, k: int = 3, d: int = 3) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = sweep(tl, [rsi_part(x, n, "_rsi")])._drop(*RSI_SCRATCH)
        return _stochastic(tl, "_rsi", n, k, d)._drop("_rsi")

    return Step(run, back=1 + n + k + d, watch=(x,), unbounded=True)


# -- ranges, bands, channels -----------------------------------------------------------------------


def true_range(tl: Timeline, close: str = "price") -> Column:
    before = F.lag(close, 1).over(tl.over())
    h, lo = F.col("high"), F.col("low")
    return F.greatest(F.abs(h - lo), F.abs(h - before), F.abs(lo - before))


def atr_part(n: int, name: str, close: str = "price", min_rows: int | None = None) -> Recurrence:
    need = n if min_rows is None else min_rows
    return Recurrence(
        before=lambda tl: {"_tr": true_range(tl, close)},
        spec=lambda tl: {name: Mean(F.col("_tr"), 1.0 / n, 0, need)},
    )


def atr(n: int, name: str, close: str = "price", min_rows: int | None = None) -> Step:
    return Step(lambda tl: sweep(tl, [atr_part(n, name, close, min_rows)])._drop("_tr"), back=1, watch=(close, "high", "low"), unbounded=True)


def bollinger(x: str = "price", n: int = 20, k: float = 2.0) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"bb_mid": full(tl, F.avg, col(x), n), "_dev": full(tl, F.stddev_samp, col(x), n)})
        mid, reach = F.col("bb_mid"), F.lit(k) * F.col("_dev")
        tl = tl.add({"bb_upper": mid + reach, "bb_lower": mid - reach})
        band = F.col("bb_upper") - F.col("bb_lower")
        return tl.add({"bb_width": band / (mid + EPS), "bb_pct_b": (col(x) - F.col("bb_lower")) / (band + EPS)})._drop("_dev")

    return Step(run, back=n)


def _channels(tl: Timeline, atr_col: str, k: float) -> Timeline:
    reach = F.lit(k) * F.col(atr_col)
    return tl.add({"kc_upper": F.col("kc_mid") + reach, "kc_lower": F.col("kc_mid") - reach})


def keltner(n: int = 20, atr_n: int = 14, k: float = 1.5) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = sweep(tl, [ema_part("price", n, "kc_mid"), atr_part(atr_n, "_atr")])
        return _channels(tl, "_atr", k)._drop("_tr", "_atr")

    return Step(run, back=1, watch=("price", "high", "low"), unbounded=True)


def parkinson(n: int = 20, name: str = "parkinson_vol") -> Step:
    def run(tl: Timeline) -> Timeline:
        swing = F.ln(F.col("high") / (F.col("low") + EPS))
        return tl.add({name: F.sqrt(full(tl, F.avg, swing * swing, n) / F.lit(4.0 * math.log(2.0)))})

    return Step(run, back=n)


def _decay_weight(q: float, count: Column) -> Column:
    """Sum of the weights 1, q, q^2, ... of ``count`` rows."""
    return (1.0 - F.pow(F.lit(q), count)) / (1.0 - q)


def movement_part(n: int) -> Recurrence:
    """Bias-corrected means of the directional moves (weighted sum over sum of weights)."""
    q, zero = 1.0 - 1.0 / n, F.lit(0.0)
    log_q = math.log(q) if q else -700.0
    up, dn = F.col("_up"), F.col("_dn")
    return Recurrence(
        before=lambda tl: {
            "_up": F.col("high") - F.lag("high", 1).over(tl.over()),
            "_dn": F.lag("low", 1).over(tl.over()) - F.col("low"),
        },
        spec=lambda tl: {
            "_plus": (log_q, F.when(up > dn, F.greatest(up, zero)).otherwise(zero)),
            "_minus": (log_q, F.when(dn > up, F.greatest(dn, zero)).otherwise(zero)),
        },
        after=lambda tl: {c: F.col(c) / _decay_weight(q, tl.pos + 1) for c in ("_plus", "_minus")},
    )


def strength_part(n: int) -> Recurrence:
    """Bias-corrected mean of the directional index, which starts with the first row that has both directions."""
    q = 1.0 - 1.0 / n
    log_q = math.log(q) if q else -700.0
    p, m = F.col("plus_di"), F.col("minus_di")
    return Recurrence(
        spec=lambda tl: {"adx": (log_q, F.when(tl.pos >= n - 1, 100.0 * F.abs(p - m) / (p + m + EPS)).otherwise(F.lit(0.0)))},
        after=lambda tl: {"adx": F.when(tl.pos >= 2 * n - 2, F.col("adx") / _decay_weight(q, tl.pos - (n - 2)))},
    )


def _directions(tl: Timeline, atr_col: str) -> Timeline:
    return tl.add({f"{s}_di": 100.0 * F.col(f"_{s}") / (F.col(atr_col) + EPS) for s in ("plus", "minus")})


MOVEMENT_SCRATCH = ("_tr", "_up", "_dn", "_plus", "_minus")


def adx(n: int = 14) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = sweep(tl, [movement_part(n), atr_part(n, "_atr")])
        tl = sweep(_directions(tl, "_atr"), [strength_part(n)])
        return tl._drop(*MOVEMENT_SCRATCH, "_atr")

    return Step(run, back=1, watch=("price", "high", "low"), unbounded=True)


# -- volume ----------------------------------------------------------------------------------------


def vwap(n: int = 20, name: str = "vwap_20") -> Step:
    def run(tl: Timeline) -> Timeline:
        typical = (F.col("high") + F.col("low") + F.col("price")) / 3.0
        return tl.add(
            {name: full(tl, F.sum, typical * F.col("volume"), n) / (full(tl, F.sum, F.col("volume"), n) + EPS)}
        )

    return Step(run, back=n)


def _signed_volume(tl: Timeline) -> Column:
    return F.signum(F.col("price") - F.lag("price", 1).over(tl.over())) * F.col("volume")


def on_balance_volume(df: DataFrame, keys=SERIES, order=TICK_ORDER, name: str = "obv") -> DataFrame:
    """Cumulative signed volume: the signs need one row of history, the sum needs all of it."""
    signed = on_series(df, Step(lambda tl: tl.add({"_signed": _signed_volume(tl)}), back=1), keys, order)
    return on_series(signed, [], keys, order, running={name: ("sum", F.col("_signed"))}, drop=("_signed",))


def obv_momentum(n: int = 20, name: str = "obv") -> Step:
    """Difference of the cumulative signed volume over ``n`` rows, as a bounded sum."""

    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"_signed": _signed_volume(tl)})
        return tl.add({name: F.when(tl.pos > n, F.sum("_signed").over(tl.over(-(n - 1), 0)))})._drop("_signed")

    return Step(run, back=n + 1)


def chaikin_flow(n: int = 20, name: str = "cmf_20") -> Step:
    def run(tl: Timeline) -> Timeline:
        p, h, lo, v = (F.col(c) for c in ("price", "high", "low", "volume"))
        place = ((p - lo) - (h - p)) / (h - lo + EPS)
        return tl.add({name: full(tl, F.sum, place * v, n) / (full(tl, F.sum, v, n) + EPS)})

    return Step(run, back=n)


def tick_intensity(n: int = 20, name: str = "tick_intensity") -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"_dv": F.col("volume") - F.lag("volume", 1).over(tl.over())})
        return tl.add({name: full(tl, F.avg, F.col("_dv"), n)})._drop("_dv")

    return Step(run, back=n + 1)


def volume_z(n: int = 20, name: str = "vol_z_20") -> Step:
    def run(tl: Timeline) -> Timeline:
        v = F.col("volume")
        return tl.add({name: (v - full(tl, F.avg, v, n)) / (full(tl, F.stddev_samp, v, n) + EPS)})

    return Step(run, back=n)


# -- returns and trend -----------------------------------------------------------------------------


def simple_returns(x: str = "price", ns: tuple[int, ...] = (1, 5, 20)) -> Step:
    return Step(
        lambda tl: tl.add({f"ret_{n}": F.try_divide(col(x), F.lag(x, n).over(tl.over())) - 1.0 for n in ns}),
        back=max(ns),
    )


def momentum(x: str = "price", ns: tuple[int, ...] = (10, 30)) -> Step:
    def run(tl: Timeline) -> Timeline:
        out = {}
        for n in ns:
            before = F.lag(x, n).over(tl.over())
            out[f"momentum_{n}"] = (col(x) - before) / (before + EPS) * 100.0
        return tl.add(out)

    return Step(run, back=max(ns))


def mean_ratio(x: str = "price", n: int = 50, name: str = "price_sma_ratio") -> Step:
    return Step(lambda tl: tl.add({name: col(x) / (full(tl, F.avg, col(x), n) + EPS)}), back=n)


def kalman_gain(pos: Column, noise: float = 0.01, drift: float = 1e-4) -> Column:
    """Gain of the scalar filter in row ``pos``; row 0 takes the value as is.

    The error after a row is a fraction-linear map of the error before it, with the fixed points ``high`` and ``low``;
    (error - high) / (error - low) shrinks by the same factor in every row, so any row's gain has a closed form.
    """
    root = math.sqrt(drift * drift + 4.0 * noise * drift)
    high, low = (root - drift) / 2.0, (-root - drift) / 2.0
    shrink = (noise - high) / (noise - low)
    ratio = F.lit((1.0 - high) / (1.0 - low)) * F.pow(F.lit(shrink), (pos - 1).cast("double"))
    error = (F.lit(high) - F.lit(low) * ratio) / (1.0 - ratio)  # after the row before
    prior = error + drift
    return F.when(pos == 0, 1.0).otherwise(prior / (prior + noise))


def kalman_gains(noise: float = 0.01, drift: float = 1e-4, tol: float = 1e-16) -> list[float]:
    """The same gains one by one, until they stop changing."""
    gains, err = [1.0], 1.0
    while len(gains) < 3 or abs(gains[-1] - gains[-2]) >= tol:
        prior = err + drift
        gains.append(prior / (prior + noise))
        err = prior * noise / (prior + noise)
    return gains


def kalman_part(x: str = "price", noise: float = 0.01) -> Recurrence:
    gain = F.col("_k_gain")
    return Recurrence(
        before=lambda tl: {"_k_gain": kalman_gain(tl.pos, noise)},
        spec=lambda tl: {
            "kalman_price": (F.when((tl.pos == 0) | col(x).isNull(), F.lit(0.0)).otherwise(F.log1p(-gain)), gain * col(x))
        },
        after=lambda tl: {"price_kalman_ratio": col(x) / (F.col("kalman_price") + EPS)},
    )


def kalman(x: str = "price", noise: float = 0.01) -> Step:
    """Filtered price and its ratio: gains depend on the row number only, so the filter is a linear recurrence."""
    return Step(lambda tl: sweep(tl, [kalman_part(x, noise)])._drop("_k_gain"), unbounded=True)


def histogram_entropy(tl: Timeline, bag: str, n: int, bins: int, name: str, normalize: bool = False) -> Timeline:
    """Entropy of an equal-width histogram of an array of ``n``, on densities (or on shares with ``normalize``).

    The counts of all bins are packed into one 64-bit number in a single fold over the array.  The steps are
    separate columns, so that nothing in the fold or after it is computed twice.
    """
    bits = n.bit_length()
    if bits * bins > 62:
        raise ValueError(f"{bins} bins of up to {n} values do not fit one number")
    tl = tl.add({"_lo": F.array_min(bag), "_hi": F.array_max(bag)})
    flat = F.col("_hi") == F.col("_lo")
    tl = tl.add(
        {
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_bin": F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins,
        }
    )

    def count(acc: Column, e: Column) -> Column:
        slot = F.least(F.floor((e - F.col("_lo")) / F.col("_bin")), F.lit(bins - 1)).cast("int")
        return acc + F.call_function("shiftleft", F.lit(1).cast("long"), slot * bits)

    tl = tl.add({"_packed": F.aggregate(bag, F.lit(0).cast("long"), count)})
    scale = F.lit(float(n)) if normalize else n * F.col("_bin")
    tl = tl.add({f"_s{b}": F.shiftright("_packed", b * bits).bitwiseAND(F.lit((1 << bits) - 1)) / scale for b in range(bins)})
    total = F.lit(0.0)
    for b in range(bins):
        share = F.col(f"_s{b}")
        total = total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return tl.add({name: F.when(F.col("_packed").isNotNull(), total)})._drop("_lo", "_hi", "_bin", "_packed", *[f"_s{b}" for b in range(bins)])


def entropy(x: str = "price", n: int = 20, bins: int = 10, name: str = "entropy_20", normalize: bool = False) -> Step:
    def run(tl: Timeline) -> Timeline:
        tl = tl.add({"_lr": F.ln(F.try_divide(col(x), F.lag(x, 1).over(tl.over())))})
        tl = tl.add({"_bag": F.collect_list("_lr").over(tl.over(-(n - 1), 0))})
        tl = tl.add({"_bag": F.when(F.size("_bag") == n, F.col("_bag"))})
        return histogram_entropy(tl, "_bag", n, bins, name, normalize)._drop("_lr", "_bag")

    return Step(run, back=n + 1)


# -- everything together ---------------------------------------------------------------------------


def indicator_frame(stochastic: bool = True) -> Step:
    """All features with shared sorts: two sweeps for all the recurrences, then the bounded windows.

    The recurrences run on few columns and without the halo, which is copied again once they are done.
    """
    bounded = [
        sma("price", 14, "sma_14"),
        sma("price", 50, "sma_50"),
        bollinger(),
        parkinson(),
        vwap(),
        obv_momentum(),
        chaikin_flow(),
        tick_intensity(),
        simple_returns(),
        momentum(),
        mean_ratio(),
        volume_z(),
        entropy(),
    ]

    def run(tl: Timeline) -> Timeline:
        reach = tl.reach
        first = [
            ema_part("price", 12, "ema_12"),
            ema_part("price", 26, "ema_26"),
            ema_part("price", 20, "kc_mid"),
            rsi_part("price", 14, "rsi_14"),
            atr_part(14, "atr_14"),
            movement_part(14),
            kalman_part(),
        ]
        tl = _directions(sweep(*prepare(tl, first)), "atr_14")._drop(*RSI_SCRATCH, *MOVEMENT_SCRATCH, "_k_gain")
        tl = tl.add({"macd": F.col("ema_12") - F.col("ema_26")})
        tl = sweep(tl, [ema_part("macd", 9, "macd_signal", 25), strength_part(14)]).spread(*reach)
        for s in bounded:
            tl = s.run(tl)
        tl = _channels(tl, "atr_14", 1.5).add({"macd_hist": F.col("macd") - F.col("macd_signal")})
        return _stochastic(tl, "rsi_14", 14, 3, 3) if stochastic else tl

    return Step(run, back=60, watch=("price", "high", "low"), unbounded=True)


def with_indicators(df: DataFrame, stochastic: bool = True, keys=SERIES, order=TICK_ORDER, drop_incomplete: bool = True) -> DataFrame:
    """The whole feature frame; rows with a missing or infinite feature are dropped unless asked otherwise."""
    names = feature_names(stochastic)
    out = on_series(df, indicator_frame(stochastic), keys, order).select(*keys, *order, *names)
    if not drop_incomplete:
        return out
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return out.where(ok)

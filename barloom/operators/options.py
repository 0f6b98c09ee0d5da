"""Option-chain slices: strike selection, summaries, and the volatility smile.

A chain has columns ts, strike, option_type ('C'/'P'), iv, delta, gamma, vega, volume, oi and the slice's spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.steps import Step, on_series
from barloom.plans.timeline import Timeline
from barloom.schema import CONTRACT_SIZE, MIN_STRIKES, MIN_YEARS_TO_EXPIRY

SLICE = ("ts",)
# Fixed value: standard normal quantile at 0.75.
Z75 = 0.6744897501960817


def is_call() -> Column:
    return F.upper("option_type") == "C"


def is_put() -> Column:
    return F.upper("option_type") == "P"


def fill_spot(chain: DataFrame, keys: Sequence[str] = SLICE) -> DataFrame:
    """A missing spot becomes the median strike of its slice."""
    mid = chain.where("spot IS NULL AND strike IS NOT NULL").groupBy(*keys).agg(F.median("strike").alias("_mid"))
    return chain.join(mid, list(keys), "left").withColumn("spot", F.coalesce("spot", "_mid")).drop("_mid")


def nearest_otm(chain: DataFrame, per_side: int = 10, fallback: int = 20, keys: Sequence[str] = SLICE, tie: Sequence[str] = ("strike",)) -> DataFrame:
    """The nearest out-of-the-money strikes per side; a slice without any keeps its nearest rows.

    Spark applies the row-number limit before the shuffle, so a large slice shrinks in place.
    """
    chain = fill_spot(chain.where("strike IS NOT NULL"), keys).withColumn("distance", F.abs(F.col("strike") - F.col("spot")))
    otm = (is_call() & (F.col("strike") > F.col("spot"))) | (is_put() & (F.col("strike") < F.col("spot")))
    side = Window.partitionBy(*keys, F.upper("option_type")).orderBy("distance", *tie)
    picked = chain.where(otm).withColumn("_n", F.row_number().over(side)).where(F.col("_n") <= per_side)
    bare = chain.join(chain.where(otm).select(*keys).distinct(), list(keys), "left_anti")
    near = Window.partitionBy(*keys).orderBy("distance", *tie)
    rest = bare.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= fallback)
    return picked.unionByName(rest).drop("_n", "distance")


def atm_iv(chain: DataFrame, keys: Sequence[str] = SLICE, tie: Sequence[str] = ("strike", "option_type")) -> DataFrame:
    """Mean volatility of the two rows nearest to the spot."""
    near = Window.partitionBy(*keys).orderBy(F.abs(F.col("strike") - F.col("spot")), *tie)
    two = chain.where("strike IS NOT NULL AND spot IS NOT NULL").withColumn("_n", F.row_number().over(near)).where("_n <= 2")
    return two.groupBy(*keys).agg(F.avg("iv").alias("atm_iv"))


def chain_summary(chain: DataFrame, keys: Sequence[str] = SLICE, tie: Sequence[str] = ("strike", "option_type")) -> DataFrame:
    """One row per slice: ATM volatility, skew, butterfly, net greeks, put/call ratios, imbalances."""
    zero = F.lit(0.0)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    sums = chain.groupBy(*keys).agg(
        F.avg(F.when(is_call(), F.col("iv"))).alias("_civ"),
        F.avg(F.when(is_put(), F.col("iv"))).alias("_piv"),
        total(F.when(is_call(), F.col("delta")).otherwise(-F.col("delta"))).alias("opt_delta_net"),
        total(F.col("gamma")).alias("opt_gamma_net"),
        total(F.col("vega")).alias("opt_vega_net"),
        (total(F.col("gamma") * F.coalesce(F.col("oi"), zero)) * CONTRACT_SIZE).alias("gex"),
        total(F.when(is_call(), F.col("volume"))).alias("_cv"),
        total(F.when(is_put(), F.col("volume"))).alias("_pv"),
        total(F.when(is_call(), F.col("oi"))).alias("_co"),
        total(F.when(is_put(), F.col("oi"))).alias("_po"),
    )
    out = sums.join(atm_iv(chain, keys, tie), list(keys), "left")
    c, p = F.col("_civ"), F.col("_piv")
    skew = F.when(F.col("atm_iv").isNotNull(), p - c)
    return out.select(
        *keys,
        "atm_iv",
        skew.alias("iv_skew"),
        ((p + c) / 2.0 - F.col("atm_iv")).alias("iv_butterfly"),
        "opt_delta_net",
        "opt_gamma_net",
        "opt_vega_net",
        "gex",
        (F.col("_pv") / (F.col("_cv") + 1.0)).alias("pcr_vol"),
        (F.col("_po") / (F.col("_co") + 1.0)).alias("pcr_oi"),
        ((F.col("_co") - F.col("_po")) / (F.col("_co") + F.col("_po") + 1.0)).alias("oi_imbalance"),
        ((F.col("_cv") - F.col("_pv")) / (F.abs("_cv") + F.abs("_pv") + 1.0)).alias("oi_flow"),
    )


# -- smile -----------------------------------------------------------------------------------------


def clean_strikes(chain: DataFrame, rate: str = "rate", years: str = "years", jump: float = 0.15, keys: Sequence[str] = SLICE) -> DataFrame:
    """Mean volatility per strike on the log-moneyness axis, without outliers and jumps against the strike below."""
    t = F.greatest(F.col(years), F.lit(MIN_YEARS_TO_EXPIRY))
    ok = chain.where((F.col("iv") >= 0.01) & (F.col("iv") <= 2.0) & (F.col("strike") > 0) & (F.col("spot") > 0))
    per = ok.groupBy(*keys, "strike").agg(
        F.avg("iv").alias("iv"), F.first("spot").alias("spot"), F.first(rate).alias("rate"), F.first(t).alias("years")
    )
    per = per.withColumn("m", F.ln(F.col("strike") / (F.col("spot") * F.exp(F.col("rate") * F.col("years")))))

    def run(tl: Timeline) -> Timeline:
        return tl.add({"_jump": F.coalesce(F.abs(F.col("iv") - F.lag("iv", 1).over(tl.over())), F.lit(0.0))})

    return on_series(per, Step(run, back=1), keys, ("m",)).where(F.col("_jump") <= jump).drop("_jump")


def _knots(rate: str, years: str, jump: float, keys: Sequence[str], chain: DataFrame) -> DataFrame:
    """One row per slice with its cleaned strikes ``_k`` as an array of (m, iv), in order of m; other slices have an empty one.

    The first aggregation combines before its shuffle and leaves one row per strike, so a slice of any size is an
    array of as many entries as it has strikes.
    """
    t = F.greatest(F.col(years), F.lit(MIN_YEARS_TO_EXPIRY))
    ok = (F.col("iv") >= 0.01) & (F.col("iv") <= 2.0) & (F.col("strike") > 0) & (F.col("spot") > 0)
    of = {"iv": F.avg(F.when(ok, F.col("iv")))} | {n: F.max(F.when(ok, c)) for n, c in (("spot", F.col("spot")), ("rate", F.col(rate)), ("years", t))}
    per = chain.groupBy(*keys, "strike").agg(*[c.alias(f"_{n}") for n, c in of.items()])
    m = F.ln(F.col("strike") / (F.col("_spot") * F.exp(F.col("_rate") * F.col("_years"))))
    knot = F.when(F.col("_iv").isNotNull(), F.struct(m.alias("m"), F.col("_iv").alias("iv")))
    slices = per.groupBy(*keys).agg(F.array_sort(F.collect_list(knot)).alias("_all"), F.max("_years").alias("_years"))
    calm = F.filter("_all", lambda k, i: (i == 0) | (F.abs(k["iv"] - F.element_at("_all", F.greatest(i, F.lit(1)))["iv"]) <= jump))
    return slices.select(*keys, "_years", calm.alias("_k"))


def _with_cubic(slices: DataFrame) -> DataFrame:
    """Intervals ``_h`` (widths), ``_s`` (secants) and knot slopes ``_d`` of the monotone cubic of each slice's knots.

    Slopes are weighted harmonic means inside and follow the three-point rule at the ends; ``_k`` is null below MIN_STRIKES.
    """
    k = lambda i: F.get("_k", i)
    each = lambda fn: F.transform(F.sequence(F.lit(0), F.size("_k") - 2), fn)
    out = slices.withColumn("_k", F.when(F.size("_k") >= MIN_STRIKES, F.col("_k")))
    out = out.withColumn("_h", each(lambda i: k(i + 1)["m"] - k(i)["m"]))
    out = out.withColumn("_s", each(lambda i: (k(i + 1)["iv"] - k(i)["iv"]) / F.get("_h", i)))
    h, s = lambda i: F.get("_h", i), lambda i: F.get("_s", i)

    def inner(i: Column) -> Column:
        hb, sb = h(i - 1), s(i - 1)
        mean = 3.0 * (h(i) + hb) / ((2.0 * h(i) + hb) / F.when(sb != 0, sb) + (h(i) + 2.0 * hb) / F.when(s(i) != 0, s(i)))
        return F.when(sb * s(i) <= 0, 0.0).otherwise(mean)

    last = F.size("_h") - 1
    first = _end_slope(h(F.lit(0)), h(F.lit(1)), s(F.lit(0)), s(F.lit(1)))
    end = _end_slope(h(last), h(last - 1), s(last), s(last - 1))
    middle = F.transform(F.sequence(F.lit(1), F.size("_h") - 1), inner)
    return out.withColumn("_d", F.concat(F.array(first), middle, F.array(end)))


def _end_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    d = ((2.0 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(s0), 0.0).when((F.signum(s0) != F.signum(s1)) & (F.abs(d) > 3.0 * F.abs(s0)), 3.0 * s0).otherwise(d)


def _at(x: Column) -> Column:
    """Value of the cubic at ``x``; the outer intervals reach beyond the ends."""
    i = F.greatest(F.least(F.size(F.filter("_k", lambda k: k["m"] <= x)), F.size("_h")), F.lit(1)) - 1
    u = x - F.get("_k", i)["m"]
    h, s, d, e = F.get("_h", i), F.get("_s", i), F.get("_d", i), F.get("_d", i + 1)
    c2, c3 = (3.0 * s - 2.0 * d - e) / h, (d + e - 2.0 * s) / (h * h)
    return F.get("_k", i)["iv"] + u * (d + u * (c2 + u * c3))


def smile(chain: DataFrame, rate: str = "rate", years: str = "years", keys: Sequence[str] = SLICE, jump: float = 0.15) -> DataFrame:
    """ATM volatility, 25-delta skew and butterfly of an interpolated smile; slices with few strikes give nulls.

    One scan, two exchanges: rows to strikes, strikes to slices; the interpolation runs inside the slice's row.
    """
    out = _with_cubic(_knots(rate, years, jump, keys, chain)).withColumn("synth_atm_iv", _at(F.lit(0.0)))
    sigma, t = F.greatest(F.col("synth_atm_iv"), F.lit(0.01)), F.col("_years")
    out = out.withColumns({"_mid": F.when(F.col("synth_atm_iv").isNotNull(), 0.5 * sigma * sigma * t), "_reach": Z75 * sigma * F.sqrt(t)})
    out = out.withColumns({"_c": _at(F.col("_mid") + F.col("_reach")), "_p": _at(F.col("_mid") - F.col("_reach"))})
    return out.select(
        *keys,
        "synth_atm_iv",
        (F.col("_p") - F.col("_c")).alias("iv_skew_25d"),
        ((F.col("_p") + F.col("_c")) / 2.0 - F.col("synth_atm_iv")).alias("iv_butterfly"),
    )

"""Cross-section of constituents per timestamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import blank_zero, clip
from barloom.operators.align import attach_weights

# Sector flows by substring of the sector name.
SECTORS = ("bank", "it", "energy", "industrial")


def heaviest(weights: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest weights with their rank (a bounded top-k over the dimension)."""
    top = weights.orderBy(F.col("weight").desc(), "symbol").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("weight").desc(), "symbol")))


def constituent_features(
    returns: DataFrame, weights: DataFrame, index_returns: DataFrame | None = None, top: int = 5, sectors: Sequence[str] = SECTORS
) -> DataFrame:
    """One row per timestamp from long returns (ts, symbol, log_ret[, is_stale]).

    All sums are partial aggregates in one pass.  A constituent without a row counts as a zero return, as in
    a wide table: it adds nothing to the sums, and the weights sum to one over all constituents.
    """
    dim = weights.join(returns.select("symbol").distinct(), "symbol", "left_semi")
    top_names = heaviest(dim, top).select("symbol", F.lit(1).alias("_top"))
    size = dim.agg(F.count(F.lit(1)).alias("_size"), F.least(F.count(F.lit(1)), F.lit(top)).alias("_tops"))
    rows = attach_weights(returns, weights).join(F.broadcast(top_names), "symbol", "left")
    r = F.coalesce(F.col("log_ret"), F.lit(0.0))
    wr, is_top = F.col("weight") * r, F.col("_top").isNotNull()
    stale = F.coalesce(F.col("is_stale"), F.lit(False)).cast("int") if "is_stale" in returns.columns else F.lit(0)

    def total(c: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0.0))

    sums = rows.groupBy("ts").agg(
        total(wr).alias("wrs"),
        total(wr * r).alias("_wrr"),
        total(wr, is_top).alias("_twr"),
        total(r, is_top).alias("_tr"),
        total(r * r, is_top).alias("_trr"),
        *[total(wr, F.lower("sector").contains(s)).alias(f"sector_{s}_flow") for s in sectors],
        F.count_if(r > 0).alias("_up"),
        F.count_if(r < 0).alias("_down"),
        F.sum(stale).alias("stale_feed_count"),
    )
    out = sums.crossJoin(F.broadcast(size))
    if index_returns is not None:
        out = out.join(index_returns.select("ts", "index_ret"), "ts", "left")
    else:
        out = out.withColumn("index_ret", F.lit(None).cast("double"))
    k = F.col("_tops")
    spread = F.try_divide(F.col("_trr") - F.col("_tr") * F.col("_tr") / k, k - 1)
    return out.select(
        "ts",
        (F.col("wrs") - F.coalesce("index_ret", F.lit(0.0))).alias("wrs_residual"),
        F.sqrt(F.greatest(F.col("_wrr") - F.col("wrs") * F.col("wrs"), F.lit(0.0))).alias("cssd"),
        clip(F.col("_twr") / blank_zero(F.col("wrs")), -5.0, 5.0).alias("concentration_ratio"),
        *[f"sector_{s}_flow" for s in sectors],
        (F.col("_up") - F.col("_down")).alias("const_adv_dec"),
        (F.col("_up") / F.greatest(F.col("_size"), F.lit(1))).alias("adv_ratio"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("top5_dispersion"),
        "stale_feed_count",
    )

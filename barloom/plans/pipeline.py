"""End-to-end plans made of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import align, clean, matrix, quality, scaling
from barloom.operators import session_features as sf
from barloom.operators.bars import resample
from barloom.operators.indicators import feature_names, with_indicators
from barloom.plans.steps import Step, on_series
from barloom.schema import BARS_PER_SESSION
from barloom.session import durable

PRICE_COLUMNS = ("price", "high", "low", "volume")


def market_frame(ticks: DataFrame, freq: str = "1 minute", min_rows: int = 500) -> DataFrame:
    """Bars for the spectral features; refuses a market with too few of them."""
    bars = resample(ticks, freq)
    n = bars.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} bars, have {n}")
    return bars


def raw_to_clean(bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Adjust, quarantine, flag stale feeds, fill gaps and add session returns (symbol, session_date, ts, seq, OHLCV)."""
    df = bars if actions is None else align.adjust_actions(bars, actions).drop("px_factor", "vol_factor")
    df = on_series(df, [clean.quarantine(), clean.stale_by_price(name="seen_stale")])
    df = clean.fill_gaps(df)
    return on_series(df, sf.log_return(), sf.SESSION)


def clean_to_features(df: DataFrame) -> DataFrame:
    """Session features and the next-bar target; the last bar of a session has no target and goes."""
    steps = [sf.volume_zscore(), sf.realised_vol(), sf.vol_of_vol(), sf.momentum_sums(), sf.direction_target()]
    df = sf.overnight_return(df)
    df = sf.vwap_deviation(df)
    return sf.drop_last_bar(on_series(df, steps, sf.SESSION))


def stage_checks(df: DataFrame, cols: Sequence[str], rows: int | None = BARS_PER_SESSION - 1) -> DataFrame:
    """The stage audit as (check, pass)."""
    numbered = clean.session_index(df)
    checks = {
        "no nulls or infinities": quality.null_audit(numbered, cols),
        "binary target": quality.target_audit(df),
        "ordered unique timestamps": quality.timestamp_audit(df, arrival="ts"),
        "rows per session": quality.session_counts(df, exact=rows, keys=("symbol",)),
    }
    return quality.stage_report(checks)


# -- spectral table --------------------------------------------------------------------------------


def spectral_samples(ticks: DataFrame, horizon: int = 1, warm_up: int = 64, indicators: DataFrame | None = None) -> DataFrame:
    """Indicator rows shifted one back against the target of the current row, without the first ``warm_up`` rows."""
    frame = indicators if indicators is not None else with_indicators(ticks)
    frame = on_series(frame, sf.signed_range_target(horizon)).where("target IS NOT NULL")
    names = [c for c in frame.columns if c not in ("symbol", "ts", "seq", "target")]

    def run(tl):
        return tl.add({c: F.lag(c, 1).over(tl.over()) for c in names} | {"_at": tl.pos})

    return on_series(frame, Step(run, back=1)).where(F.col("_at") >= warm_up).drop("_at")


def select_indicators(samples: DataFrame, top_n: int, names: Sequence[str] | None = None) -> list[str]:
    """Indicator names by score; a list of at most ``top_n`` names comes to the driver."""
    known = [c for c in samples.columns if c in feature_names() and c not in PRICE_COLUMNS]
    if names:
        picked = [c.strip() for c in names if c.strip() in known][:top_n]
        if len(picked) < 2:
            raise ValueError("explicit list holds fewer than two known indicators")
        return picked
    top = quality.top_features(quality.feature_scores(samples, known, "target"), top_n)
    return [r["feature"] for r in top.orderBy("rank").select("feature").take(top_n)]


def spectral_table(
    samples: DataFrame, top_n: int = 10, corr_window: int = 60, names: Sequence[str] | None = None, quantile_range: tuple[float, float] = (15.0, 85.0), fit_on: DataFrame | None = None
) -> DataFrame:
    """Eigenvalues of the rolling indicator correlations, the scaled indicators, label and return.

    The samples are pinned, since selection, scaling and the matrices each read them.  ``fit_on`` limits selection and scaling to train rows; by default all rows are used.
    """
    samples = durable(samples)
    base = samples if fit_on is None else fit_on
    picked = select_indicators(base, top_n, names)
    params = scaling.fit_robust(base, picked, *scaling.sane_range(*quantile_range), keys=())
    rows = scaling.apply_scale(samples.select("symbol", "ts", "seq", "target", *picked), params, picked, keys=())
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in picked})
    out = matrix.map_correlations(rows, picked, corr_window, keep=("target",), spectrum=True)
    return out.select(
        "symbol",
        "ts",
        "seq",
        *[F.get("eigenvalues", F.lit(i)).alias(f"corr_eigenvalue_{i + 1:02d}") for i in range(len(picked))],
        *[F.col(c).alias(f"indicator_{c}") for c in picked],
        (F.col("target") > 0).cast("int").alias("label"),
        "target",
    )

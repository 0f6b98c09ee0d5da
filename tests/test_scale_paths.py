"""Operators in the forms that hold at scale, against plain NumPy or Python versions."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.custom import normal_cdf, rolling_apply
from barloom.operators import align, matrix, scaling
from barloom.plans.steps import on_series


def plain_quantile(values, weights, q):
    v = np.repeat(values, weights)
    v = np.sort(v)
    at = q * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if at == math.floor(at) else lo + (hi - lo) * (at - math.floor(at))


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles_by_narrowing(spark, split_groups, weighted):
    rng = np.random.default_rng(8)
    n = 4000
    columns = {
        "normal": rng.normal(0, 1, n),
        "tied": np.round(rng.normal(0, 2, n)),
        "flat": np.full(n, 7.25),
        "wild": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n),
        "level": 1e6 + rng.normal(0, 1e-3, n),
        "split": np.where(np.arange(n) < n // 2, 1.0 + rng.random(n), 1e12 * (1 + rng.random(n))),
        "ends": np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.4, -np.inf, rng.normal(0, 1, n))),
    }
    pdf = pd.DataFrame(columns).assign(fold=rng.integers(0, 2, n), w=rng.integers(0, 4, n))
    pdf.loc[rng.random(n) < 0.05, "normal"] = None
    df = spark.createDataFrame(pdf).withColumn("normal", F.nanvl("normal", F.lit(None).cast("double")))
    qs = [0.0, 0.15, 0.25, 0.5, 0.85, 0.999, 1.0]
    split_groups(20)
    got = {r.fold: r for r in scaling.quantiles(df, list(columns), qs, weight=F.col("w") if weighted else None).collect()}
    for fold, part in pdf.groupby("fold"):
        for c in columns:
            own = part[part[c].notna()]
            want = [plain_quantile(own[c].to_numpy(float), own.w if weighted else np.ones(len(own), int), q) for q in qs]
            np.testing.assert_allclose(got[fold][f"{c}_q"], want, rtol=1e-12, err_msg=c)
    whole = scaling.quantiles(df, ["tied"], [0.5], keys=()).first()["tied_q"]
    assert whole == [plain_quantile(pdf.tied.to_numpy(), np.ones(n, int), 0.5)]


def plain_factors(bars, actions):
    """Events one by one; ``bars``: (symbol, date, ts, close), ``actions``: (symbol, ex_date, split, dividend)."""
    out = {}
    for symbol in {a[0] for a in actions}:
        own = sorted(a for a in actions if a[0] == symbol)
        closes = sorted((t, d, c) for s, d, t, c in bars if s == symbol and c is not None)
        done = []
        for _, ex, split, paid in own:
            seen = next(((d, c) for _, d, c in reversed(closes) if d < ex), None)
            own_factor = 1 / split if split and split > 0 and split != 1 else 1.0
            cut = 1.0
            if seen:
                px = seen[1] * own_factor * math.prod(f for e, f, _ in done if e > seen[0])
                cut = (px - paid) / px if px > 0 and paid and paid > 0 else 1.0
            done.append((ex, own_factor * cut, split if split and split > 0 and split != 1 else 1.0))
        for k, (ex, _, _) in enumerate(done):
            out[symbol, ex] = (math.prod(f for _, f, _ in done[k:]), math.prod(v for _, _, v in done[k:]))
    return out


def test_action_factors_equal_one_by_one(spark, split_groups):
    rng = np.random.default_rng(5)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=int(k))
    bars = [(s, day(k), dt.datetime(2024, 1, 1) + dt.timedelta(days=k), None if rng.random() < 0.1 else float(rng.uniform(0.5, 20))) for s in "ab" for k in range(0, 120) if rng.random() < 0.5]
    actions = [(s, day(k), float(rng.choice([0.0, 1.0, 2.0, 0.5, 3.0])), float(rng.choice([0.0, 0.1, 0.7, 6.0]))) for s in "abc" for k in rng.choice(130, 60, replace=False)]
    b = spark.createDataFrame(bars, "symbol string, session_date date, ts timestamp_ntz, close double")
    a = spark.createDataFrame(actions, "symbol string, ex_date date, split_ratio double, dividend_amount double")
    want = plain_factors(bars, actions)
    for limit in (500_000, 8):
        split_groups(limit)
        got = {(r.symbol, r.ex_date): (r.px_factor, r.vol_factor) for r in align.action_factors(b, a).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert np.allclose(got[k], v, rtol=1e-9, atol=1e-12), k
    assert any(v[0] <= 0 for v in want.values())  # a dividend above the price is among the cases


def test_a_symbol_with_many_actions(spark):
    n = 100_000
    base = dt.date(1700, 1, 1)
    acts = spark.range(n).select(F.lit("x").alias("symbol"), F.date_add(F.lit(base), F.col("id").cast("int")).alias("ex_date"), F.when(F.col("id") % 2 == 0, 1.01).otherwise(1 / 1.01).alias("split_ratio"), F.lit(0.0).alias("dividend_amount"))
    bars = spark.createDataFrame([("x", base, dt.datetime(1700, 1, 1), 10.0)], "symbol string, session_date date, ts timestamp_ntz, close double")
    start = time.time()
    rows = align.action_factors(bars, acts).agg(F.count("*").alias("n"), F.min("px_factor").alias("low"), F.max("px_factor").alias("high")).first()
    assert rows.n == n and abs(rows.low - 1) < 1e-6 and abs(rows.high - 1.01) < 1e-6
    assert time.time() - start < 90


def test_rolling_comoments_in_one_pass():
    rng = np.random.default_rng(6)
    n, rows = 20, 3000
    steps = np.where(np.arange(rows) > 1500, 1e7, 0.0)
    values = np.stack([1e6 + rng.normal(0, 1, rows), rng.normal(0, 1, rows).cumsum(), steps + rng.normal(0, 1e-3, rows), np.where(np.arange(rows) % 200 < 60, 3.0, rng.normal(0, 1, rows)), np.full(rows, 0.1)], axis=1)
    got = matrix.rolling_comoments(values, n)
    windows = np.lib.stride_tricks.sliding_window_view(values, n, axis=0)
    want = matrix._direct(windows)
    dev = np.sqrt(np.einsum("rii->ri", want))
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max() and (np.abs(got - want) <= 1e-7 * dev[:, :, None] * dev[:, None, :] + 1e-12).all()
    assert (got[:, 4] == 0).all() and (got[np.ptp(windows, axis=2)[:, 3] == 0][:, 3] == 0).all()
    corr = matrix._rolling_corr(values[:, :3], n)[n - 1 :]
    plain = np.array([np.corrcoef(w) for w in windows[:, :3]])
    assert np.abs(corr - plain).max() < 1e-6


def test_keyless_correlations_use_many_tasks(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(0, 1, (5000, 4)).cumsum(axis=0) + 1e6, columns=list("wxyz"))
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(5000), unit="m")
    pdf.loc[777, "x"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    out = matrix.rolling_correlations(df, list("wxyz"), 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("FlatMapGroupsInPandas")[0]
    got = out.orderBy("ts").toPandas()
    for a, b in (("w", "x"), ("y", "z")):
        windows = np.lib.stride_tricks.sliding_window_view(pdf[[a, b]].to_numpy(), 30, axis=0)
        want = np.array([np.corrcoef(w)[0, 1] for w in windows])
        want[777 - 29 : 777 + 1] = 0.0  # a null makes its windows the identity
        assert np.abs(got[f"corr_{a}__{b}"].to_numpy() - want).max() < 1e-6


def test_function_over_a_sliding_view(spark, split_groups):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"symbol": np.where(np.arange(4000) % 4 == 0, "b", "a"), "ts": range(4000), "seq": range(4000), "x": rng.normal(0, 1, 4000)})
    pdf.loc[rng.random(4000) < 0.01, "x"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    want = pdf.groupby("symbol").x.rolling(6).median().reset_index(0, drop=True).sort_index()
    for limit in (500_000, 1024):
        split_groups(limit)
        got = on_series(df, rolling_apply("x", 6, np.median, "m")).toPandas().set_index("seq").sort_index()
        assert np.allclose(got.m.astype(float), want, equal_nan=True)


def test_normal_cdf(spark):
    xs = np.concatenate([np.linspace(-38, 38, 400), [0.0, 4.0, -4.0, 1e-9]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    rows = df.select("x", normal_cdf(F.col("x")).alias("p")).collect()
    for r in rows[:-1]:
        assert math.isclose(r.p, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=1e-12, abs_tol=1e-300)
    assert rows[-1].p is None

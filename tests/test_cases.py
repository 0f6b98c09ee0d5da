"""Small hand-made and NumPy-checked cases, and the paths that only large groups take."""

import itertools
import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import align, clean, folds, matrix, options, quality, scaling, trials
from barloom.operators import evaluate as ev
from barloom.operators import session_features as sf
from barloom.plans.steps import on_series
from barloom.sources import payloads, readers, sinks
from barloom.streaming import ordered, state


def preds(spark, y, p):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "idx long, y_true double, y_pred double")


# -- evaluation ------------------------------------------------------------------------------------


def test_trade_stats_by_hand(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.5, -0.25, 0.0, 0.25])], "idx int, pnl double")
    r = df.agg(*ev.trade_stats()).first()
    assert (r.win_rate, r.profit_factor, r.total_trades) == (pytest.approx(2 / 3), 3.0, 4)
    won = df.where("pnl >= 0").agg(*ev.trade_stats()).first()
    assert math.isinf(won.profit_factor)


def test_longest_losing_run_by_hand(spark, split_groups):
    pnl = [1, -1, -1, 0, -1, -1, -1, 2] + [1] * 2000 + [-1] * 1500
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(pnl)], "idx int, pnl double")
    assert sf.losing_runs(df.where("idx < 8")).agg(F.max("losing_run")).first()[0] == 3
    split_groups(1024)
    assert sf.losing_runs(df).agg(F.max("losing_run")).first()[0] == 1500


def direct_cpcv(y, p, trim=45):
    """Test masks built row by row."""
    n, acc, sharpe = len(y), [], []
    edges = [g * n // 16 for g in range(17)]
    for _, part in itertools.groupby(folds.combination_rows(16, 8, 200, 42), key=lambda r: r[0]):
        mask = np.zeros(n, dtype=bool)
        for _, g, cut_l, cut_r in part:
            mask[edges[g] + (trim if cut_l else 0) : max(edges[g + 1] - (trim if cut_r else 0), 0)] = True
        if mask.sum() < 16:
            continue
        pnl = np.sign(p[mask]) * y[mask]
        acc.append((np.sign(y[mask]) == np.sign(p[mask])).mean())
        sharpe.append(pnl.mean() / (pnl.std() + 1e-12) * np.sqrt(252))
    return np.array(acc), np.array(sharpe)


def test_cross_validation_equals_direct_masks(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(0, 1, 2048)
    p = 0.1 * y + rng.normal(0, 1, 2048)
    r = ev.cpcv(preds(spark, y, p)).first()
    acc, sharpe = direct_cpcv(y, p)
    assert r.n_combinations_evaluated == len(acc)
    assert r.directional_accuracy_mean == pytest.approx(acc.mean(), abs=1e-12)
    assert r.sharpe_std == pytest.approx(sharpe.std(), abs=1e-9)
    assert r.sharpe_ci95_low == pytest.approx(np.percentile(sharpe, 2.5), abs=1e-9)
    want = 0.5 * (1 + math.erf(-sharpe.mean() / (sharpe.std() * math.sqrt(2))))
    assert r.pbo_proxy == pytest.approx(want, abs=1e-9)


def test_overfitting_proxy_is_the_tail_of_the_combination_ratios(spark):
    """The proxy is the normal tail below zero of the ratios that the combinations themselves report."""
    from math import erf, sqrt

    rows = np.arange(900)
    truth = np.sin(rows / 7.0) + 0.3 * np.cos(rows * 1.7)
    for weight in (0.05, -0.05):
        made = preds(spark, truth, weight * truth + np.cos(rows * rows % 101))
        ratios = np.array([r.sharpe for r in ev.cpcv_combinations(made).collect()])
        want = 0.5 * (1 + erf(-ratios.mean() / ratios.std() / sqrt(2)))
        assert abs(ev.cpcv(made).first().pbo_proxy - want) < 1e-9


@pytest.mark.parametrize("shape", ["normal", "right", "left", "narrow", "tiny"])
def test_power_exponent_has_the_highest_likelihood(spark, shape):
    rng = np.random.default_rng(12)
    x = {
        "normal": lambda: rng.normal(0, 1, 800),
        "right": lambda: rng.lognormal(0, 0.7, 800),
        "left": lambda: -rng.lognormal(0, 0.5, 800),
        "narrow": lambda: 0.2 * rng.lognormal(0, 0.4, 800),
        "tiny": lambda: 0.01 * rng.lognormal(0, 0.6, 800),
    }[shape]()

    def like(lam):
        k = np.where(x >= 0, lam, 2 - lam)
        size = np.log1p(np.abs(x))
        y = np.sign(x) * np.where(np.abs(k) < 1e-12, size, np.expm1(k * size) / np.where(k == 0, 1, k))
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * size).sum()

    grid = np.arange(-300, 60, 0.5)
    best = grid[np.argmax([like(g) for g in grid])]
    for step in (0.01, 0.0005):
        near = np.arange(best - 60 * step, best + 60 * step, step)
        best = near[np.argmax([like(g) for g in near])]
    got = scaling.fit_power(spark.createDataFrame([(0, float(v)) for v in x], "fold int, x double"), ["x"], ["fold"]).first().x_lambda
    assert abs(got - best) < 1e-3 * max(1, abs(best)), (got, best)


def test_too_few_rows_for_cross_validation(spark):
    r = ev.cpcv(preds(spark, [1, 2, 3], [1, 2, 3])).first()
    assert (r.n_combinations_evaluated, r.pbo_proxy) == (0, 1.0)


def test_backtest_report_has_all_parts(spark):
    rng = np.random.default_rng(42)
    r = ev.backtest(preds(spark, rng.normal(size=100), rng.normal(size=100))).first()
    assert r.total_trades == 100 and r.winning_trades + r.losing_trades <= 100
    assert r.cpcv.n_combinations_evaluated >= 0 and r.max_drawdown_proxy <= 0


def test_auc_in_chunks(spark, split_groups):
    rng = np.random.default_rng(3)
    prob, label = np.round(rng.uniform(0.01, 0.99, 5000), 4), rng.integers(0, 2, 5000)
    df = spark.createDataFrame(pd.DataFrame({"prob": prob, "label": label}))
    ranks = pd.Series(prob).rank().to_numpy()
    pos = label.sum()
    want = (ranks[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (5000 - pos))
    split_groups(1024)
    assert ev.log_loss_auc(df).first().auc == pytest.approx(want, abs=1e-12)


# -- scaling ---------------------------------------------------------------------------------------


def test_exact_quantiles_of_a_large_group(spark, split_groups):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"fold": [0] * 6000 + [1] * 50, "x": rng.normal(size=6050), "y": rng.integers(0, 9, 6050).astype(float)})
    df = spark.createDataFrame(pdf).repartition(5)
    weight = F.when(F.col("y") > 4, 3).otherwise(1)
    plain = {r.fold: r for r in scaling.quantiles(df, ["x", "y"], [0.1, 0.5, 0.75]).collect()}
    plain_w = {r.fold: r for r in scaling.quantiles(df, ["x"], [0.3, 0.5], weight=weight).collect()}
    split_groups(1024)
    split = {r.fold: r for r in scaling.quantiles(df, ["x", "y"], [0.1, 0.5, 0.75]).collect()}
    split_w = {r.fold: r for r in scaling.quantiles(df, ["x"], [0.3, 0.5], weight=weight).collect()}
    for k in (0, 1):
        want = np.quantile(pdf[pdf.fold == k].x, [0.1, 0.5, 0.75])
        assert np.allclose(plain[k].x_q, want) and np.allclose(split[k].x_q, want)
        assert np.allclose(split[k].y_q, plain[k].y_q)
        assert np.allclose(split_w[k].x_q, plain_w[k].x_q)


def test_power_exponent_near_a_fine_grid(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(2.0, 2.0, 400) - 1.0
    df = spark.createDataFrame(pd.DataFrame({"fold": 0, "x": x}))
    r = scaling.fit_power(df, ["x"]).first()

    def like(lam):
        pos = np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam
        neg = -(((1 + np.abs(x)) ** (2 - lam)) - 1) / (2 - lam)
        y = np.where(x >= 0, pos, neg)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-1, 1.9, 29_001)
    best = grid[np.argmax([like(g) for g in grid])]
    assert r.x_lambda == pytest.approx(best, abs=3e-4)
    out = scaling.apply_power(df, scaling.fit_power(df, ["x"]), ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1, abs=1e-9)


def test_sequence_weights_equal_enumeration(spark):
    n, length = 40, 6
    samples = int(0.8 * (n - length))
    counts = np.zeros(n, dtype=int)
    for e in range(length, length + samples):
        counts[e - length : e] += 1
    df = spark.range(n).select("id", scaling.sequence_weight(F.col("id"), length, F.lit(samples)).alias("w"))
    assert [r.w for r in df.orderBy("id").collect()] == counts.tolist()


# -- folds -----------------------------------------------------------------------------------------


def test_purged_folds_keep_the_embargo(spark):
    ts = pd.date_range("2026-01-05 03:45", periods=375 * 5, freq="1min")
    pdf = pd.DataFrame({"ts": ts, "seq": range(len(ts)), "idx": range(len(ts)), "bar_index": np.arange(len(ts)) % 375})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = folds.purged(df, 3).groupBy("fold").pivot("role", ["train", "val"]).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert len(got) == 3
    for r in got:
        assert (r.val_lo - r.train_hi).total_seconds() >= 30 * 60


def test_hashed_split_ignores_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k: r.role for r in folds.hashed_split(df.repartition(3), ["k"]).collect()}
    assert a == {r.k: r.role for r in folds.hashed_split(df.repartition(11), ["k"]).collect()}
    assert 0.75 < sum(v == "train" for v in a.values()) / 2000 < 0.85


# -- cleaning and alignment ------------------------------------------------------------------------


def session_bars(spark, closes, volumes=None):
    rows = [
        ("s", datetime(2026, 1, 5, 9, i), i, date(2026, 1, 5), c, c, c, c, 1.0 if volumes is None else float(volumes[i])) for i, c in enumerate(closes)
    ]
    schema = "symbol string, ts timestamp_ntz, seq long, session_date date, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema)


def test_silent_feed_counts_one_more_at_the_start(spark):
    df = session_bars(spark, [1.0] * 14, [0, 0, 0, 0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 1])
    got = [r.is_stale for r in on_series(df, clean.stale_by_volume()).orderBy("seq").collect()]
    assert [i for i, x in enumerate(got) if x] == [5, 11, 12]


def test_frozen_quotes_and_gap_filling(spark):
    got = [r.is_stale for r in on_series(session_bars(spark, [2.0] * 8 + [3.0]), clean.stale_by_price()).orderBy("seq").collect()]
    assert [i for i, x in enumerate(got) if x] == [4, 5, 6, 7]
    df = session_bars(spark, [None, 1.0, None, None, 4.0, None])
    assert [r.close for r in clean.fill_gaps(df).orderBy("seq").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_impossible_bar_is_blanked(spark):
    df = session_bars(spark, [10.0, 10.0, 10.0]).withColumn("high", F.when(F.col("seq") == 1, 5.0).otherwise(F.col("high")))
    rows = on_series(df, clean.quarantine()).orderBy("seq").collect()
    assert [r.is_invalid_bar for r in rows] == [False, True, False] and rows[1].close is None


def test_actions_without_a_bar_between_see_each_other(spark):
    """A dividend after a split with no bar in between uses the split-adjusted close; so does a same-day pair."""
    bars = session_bars(spark, [100.0, 100.0])
    acts = spark.createDataFrame(
        [("s", date(2026, 1, 6), 2.0, None), ("s", date(2026, 1, 8), None, 5.0)], "symbol string, ex_date date, split_ratio double, dividend_amount double"
    )
    got = align.adjust_actions(bars, acts).first()
    assert got.close == pytest.approx(100 / 2 * (50 - 5) / 50) and got.volume == 2.0
    same = spark.createDataFrame([("s", date(2026, 1, 6), 2.0, 5.0)], acts.schema)
    assert align.adjust_actions(bars, same).first().close == pytest.approx(45.0)


def test_asof_join_in_chunks(spark, split_groups):
    rng = np.random.default_rng(9)
    start = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"symbol": "a", "ts": start + pd.to_timedelta(np.sort(rng.integers(0, 50_000, 3000)), unit="s")}).drop_duplicates()
    right = pd.DataFrame({"symbol": "a", "ts": start + pd.to_timedelta(np.sort(rng.choice(50_000, 1500, replace=False)), unit="s")})
    right["seq"], right["v"] = range(len(right)), rng.normal(size=len(right))
    want = pd.merge_asof(left, right[["ts", "v"]], on="ts", tolerance=pd.Timedelta("60s"))
    ntz = lambda p: spark.createDataFrame(p).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    split_groups(1024)
    got = align.asof_join(ntz(left), ntz(right), ["v"], tolerance="60 SECONDS").toPandas().sort_values("ts")
    assert np.allclose(got["v"].astype(float).to_numpy(), want["v"].to_numpy(), equal_nan=True)


def test_payload_without_spot_uses_the_median_strike(spark):
    doc = '{"data": [{"strike_price": 100, "call_options": {"iv": 0.2, "oi": 5}, "put_options": {"iv": 0.3}}, {"strike_price": 110, "call_options": {"iv": 0.25}, "put_options": {}}]}'
    rows = payloads.option_rows(spark.createDataFrame([(1, doc)], "k int, doc string"), "doc", ("k",))
    assert sorted((r.strike, r.option_type) for r in rows.collect()) == [(100.0, "C"), (100.0, "P"), (110.0, "C")]
    chain = rows.withColumns({"ts": F.lit(1), "spot": F.lit(None).cast("double")})
    assert options.fill_spot(chain).first().spot == 100.0


def test_smile_needs_six_strikes_and_is_monotone_between(spark):
    strikes = [80, 90, 95, 100, 105, 110, 120]
    ivs = [0.30, 0.26, 0.24, 0.22, 0.215, 0.22, 0.23]
    rows = [(1, float(k), "C", v, 101.0, 0.0, 30 / 365) for k, v in zip(strikes, ivs)] + [(2, 100.0, "C", 0.2, 101.0, 0.0, 30 / 365)]
    df = spark.createDataFrame(rows, "ts int, strike double, option_type string, iv double, spot double, rate double, years double")
    out = {r.ts: r for r in options.smile(df).collect()}
    assert out[2].synth_atm_iv is None
    assert 0.215 < out[1].synth_atm_iv < 0.22 and out[1].iv_skew_25d > 0


# -- matrices --------------------------------------------------------------------------------------


def test_rolling_matrices_equal_numpy(spark, split_groups):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(3000, 3)), columns=["a", "b", "c"])
    pdf.loc[500:600, "c"] = 1.0
    pdf["symbol"], pdf["ts"], pdf["seq"] = "s", pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(3000), unit="s"), range(3000)
    df = spark.createDataFrame(pdf)
    split_groups(1024)
    got = matrix.map_correlations(df, ["a", "b", "c"], 60).toPandas().sort_values("seq")
    assert len(got) == 3000 - 59
    for at in (59, 570, 1023, 1024, 2999):
        w = pdf.loc[at - 59 : at, ["a", "b", "c"]].to_numpy()
        with np.errstate(all="ignore"):
            want = np.corrcoef(w.T)
        want = np.eye(3) if not np.isfinite(want).all() else want
        assert np.allclose(np.array(got[got.seq == at].iloc[0]["corr"]).reshape(3, 3), want, atol=1e-9)
    eig = matrix.map_correlations(df.where("seq < 200"), ["a", "b", "c"], 60, spectrum=True).first().eigenvalues
    assert eig == sorted(eig, reverse=True) and sum(eig) == pytest.approx(3)


def test_short_series_has_neutral_persistence(spark):
    df = spark.createDataFrame([("s", i, i, float(i % 3)) for i in range(30)], "symbol string, ts int, seq int, x double")
    assert matrix.hurst(df, "x").first().hurst == 0.5


# -- audits and trials -----------------------------------------------------------------------------


def test_correlation_of_flat_or_short_pairs_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None), (1.0, 5.0)], "x double, y double")
    assert df.agg(quality.safe_corr("x", "y")).first()[0] == 0.0
    assert df.limit(2).agg(quality.safe_corr("y", "x")).first()[0] == 0.0


def test_plateau_reasons(spark):
    space = [trials.Range("lr", 0.001, 1.0, "log"), trials.Choice("kind", ("a", "b"))]
    rows = [(i, "COMPLETE", float(i % 4), 0.01 * (i + 1), "a") for i in range(20)]
    df = spark.createDataFrame(rows, "trial_id int, state string, score double, lr double, kind string")
    full = trials.plateau(df, df.where("trial_id = 3"), space).first()
    assert full.reason == "ok" and full.penalty >= 0 and full.neighbor_count >= 4
    few = df.where("trial_id < 5")
    assert trials.plateau(few, few.where("trial_id = 3"), space).first().reason == "insufficient_completed_trials"


def test_explicit_indicator_list_needs_two_known_names(spark):
    with pytest.raises(ValueError):
        quality.top_features(spark.createDataFrame([("a", 1.0)], "feature string, score double"), 3, ["x", "a"], ["a"])


# -- sources, sinks, streams -----------------------------------------------------------------------


def test_day_table_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "days")
    df = session_bars(spark, [1.0, 2.0]).unionByName(session_bars(spark, [3.0]).withColumn("session_date", F.lit("2026-01-06").cast("date")))
    sinks.write_days(df, path)
    sinks.write_days(df.where("session_date = '2026-01-06'").withColumn("close", F.lit(9.0)), path)
    back = spark.read.parquet(path)
    assert sorted(r.close for r in back.collect()) == [1.0, 2.0, 9.0]
    assert back.schema["close"].metadata["schema_version"] == "3.0"
    want = spark.createDataFrame([(date(2026, 1, 6),), (date(2026, 1, 7),)], "session_date date")
    assert [r.session_date for r in sinks.pending_days(want, back).collect()] == [date(2026, 1, 7)]


def test_tick_files_by_suffix_and_missing_columns(spark, tmp_path):
    pdf = pd.DataFrame({"timestamp": ["2024-01-01 09:00:00", "2024-01-01 09:00:00", "bad"], "price": [1.0, 2.0, 3.0], "high": 4.0, "low": 0.5, "volume": 1})
    csv = str(tmp_path / "t.csv")
    pdf.to_csv(csv, index=False)
    assert readers.read_ticks(spark, csv).count() == 1
    assert readers.read_ticks(spark, csv, dedupe=False).count() == 2
    pdf.drop(columns="volume").to_csv(csv, index=False)
    with pytest.raises(ValueError, match="volume"):
        readers.read_ticks(spark, csv)
    with pytest.raises(ValueError, match="suffix"):
        readers.read_ticks(spark, str(tmp_path / "t.json"))


def test_newest_files_only(spark, tmp_path):
    for day, px in (("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)):
        pdf = pd.DataFrame({"timestamp": [pd.Timestamp(day)], "idx_close": px, "idx_high": px, "idx_low": px, "idx_volume": 1.0})
        (tmp_path / "a").mkdir(exist_ok=True)
        pdf.to_parquet(tmp_path / "a" / f"master_{day}.parquet", coerce_timestamps="us")
    got = readers.read_tick_tree(spark, str(tmp_path), newest=2)
    assert sorted(r.price for r in got.collect()) == [2.0, 3.0]


def test_files_without_rows_are_named(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = pd.DataFrame({"timestamp": [pd.Timestamp("2024-01-01")], "idx_close": 1.0, "idx_high": 1.0, "idx_low": 1.0, "idx_volume": 1.0})
    good.to_parquet(tmp_path / "a" / "good.parquet", coerce_timestamps="us")
    good.head(0).to_parquet(tmp_path / "empty.parquet", coerce_timestamps="us")
    (tmp_path / "a" / "torn.parquet").write_bytes((tmp_path / "a" / "good.parquet").read_bytes()[:-20])
    assert readers.read_tick_tree(spark, str(tmp_path)).count() == 1
    got = {r.path.rsplit("/", 1)[1]: r.length for r in readers.silent_files(spark, str(tmp_path)).collect()}
    assert got.keys() == {"empty.parquet", "torn.parquet"} and got["torn.parquet"] == (tmp_path / "a" / "torn.parquet").stat().st_size


def two_batches(spark, folder, rows=120):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(
        {
            "symbol": np.where(np.arange(rows) % 3 == 0, "b", "a"),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(rows), unit="m"),
            "seq": np.arange(rows),
            "price": 50 + rng.normal(0, 1, rows).cumsum(),
        }
    )
    df = spark.createDataFrame(pdf)
    df.where("seq < 70").coalesce(1).write.parquet(folder)
    df.where("seq >= 70").coalesce(1).write.mode("append").parquet(folder)
    return pdf, df.schema


def add_heartbeat(spark, folder, schema):
    """A later row that moves the watermark past all others."""
    spark.createDataFrame([("heartbeat", pd.Timestamp("2024-01-03").to_pydatetime(), -1, None)], schema).coalesce(1).write.mode("append").parquet(folder)


def test_state_continues_over_micro_batches(spark, tmp_path):
    from barloom.operators import indicators as ind
    from barloom.streaming import bars

    pdf, schema = two_batches(spark, str(tmp_path / "in"))
    add_heartbeat(spark, str(tmp_path / "in"), schema)
    stream = bars.tick_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    q = bars.drain(ordered.stream_recurrences(stream), str(tmp_path / "rec"))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    got = spark.read.parquet(str(tmp_path / "rec/rows")).toPandas().sort_values("seq").set_index("seq")
    batch = on_series(spark.createDataFrame(pdf), [ind.ema("price", 12, "ema"), ind.rsi("price", 14, "rsi"), ind.kalman()])
    want = batch.toPandas().set_index("seq").sort_index()
    for c in ("ema", "rsi", "kalman_price"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c

    two_batches(spark, str(tmp_path / "plain"))
    stream = bars.tick_stream(spark, str(tmp_path / "plain"), schema, files_per_batch=1)
    state.run_steps(stream, [state.stream_buffer("price", 10)], str(tmp_path / "buf"))
    got = spark.read.parquet(str(tmp_path / "buf/rows")).toPandas().set_index("seq").sort_index()
    want = pdf.groupby("symbol").price.transform(lambda s: s.rolling(10).mean())
    assert np.allclose(got["score"].astype(float), want, equal_nan=True)


def test_pipeline_stages(spark):
    from barloom.plans import pipeline

    rng = np.random.default_rng(42)
    frames = []
    for d in range(3):
        ts = pd.date_range(f"2026-01-0{5 + d} 03:45", periods=375, freq="1min")
        px = 78_000 + rng.normal(0, 15, 375).cumsum() / 5
        frames.append(pd.DataFrame({"ts": ts, "session_date": ts[0].date(), "close": px, "open": px - 2, "high": px + 3, "low": px - 4, "volume": rng.integers(1000, 5000, 375).astype(float)}))
    pdf = pd.concat(frames, ignore_index=True)
    pdf["symbol"], pdf["seq"] = "idx", range(len(pdf))
    pdf.loc[400, "high"] = 1.0
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    feats = pipeline.clean_to_features(pipeline.raw_to_clean(df))
    assert feats.count() == 3 * 374
    checks = {r.check: r["pass"] for r in pipeline.stage_checks(feats, ["close", "rv_5", "vwap_dev"]).collect()}
    assert all(checks.values()), checks

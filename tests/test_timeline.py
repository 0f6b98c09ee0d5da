"""The chunked layout must give what plain windows give, and recurrences what pandas gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.plans.steps import on_series
from barloom.plans.timeline import BLOCK, lay_out

HOT_ROWS = 12_000


@pytest.fixture(scope="module")
def hot(spark):
    """One symbol with most of the rows, two small ones."""
    rng = np.random.default_rng(5)
    n = HOT_ROWS + 700 + 3
    symbol = np.array(["hot"] * HOT_ROWS + ["mid"] * 700 + ["tiny"] * 3)
    price = 100 + np.cumsum(rng.normal(0, 0.3, n)) * 0.1
    pdf = pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="s"),
            "seq": np.arange(n),
            "price": price,
            "high": price * (1 + rng.uniform(0, 0.01, n)),
            "low": price * (1 - rng.uniform(0, 0.01, n)),
            "volume": rng.integers(0, 50, n).astype(float),
        }
    )
    df = spark.createDataFrame(pdf.sample(frac=1.0, random_state=1)).repartition(7)
    return df, pdf


def frame(df):
    return df.toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)


def close(a, b, cols, tol=1e-8):
    for c in cols:
        x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
        assert (np.isnan(x) == np.isnan(y)).all(), c
        assert np.nanmax(np.abs(x - y), initial=0) < tol, c


def test_chunks_number_rows_exactly(spark, hot, split_groups):
    df, pdf = hot
    split_groups(BLOCK)
    tl = lay_out(df, ["symbol"], ["ts", "seq"])
    assert tl.chunked
    got = frame(tl.df.select("symbol", "seq", "_pos", "_chunk"))
    assert (got["_pos"] == got.groupby("symbol").cumcount()).all()
    assert got.groupby(["symbol", "_chunk"]).size().max() <= BLOCK


def test_indicators_do_not_depend_on_layout(spark, hot, split_groups):
    df, _ = hot
    names = [n for n in ind.feature_names() if n != "entropy_20"]
    plain = frame(ind.with_indicators(df, drop_incomplete=False))
    split_groups(5 * BLOCK)
    assert lay_out(df, ["symbol"], ["ts", "seq"]).chunked
    split = frame(ind.with_indicators(df, drop_incomplete=False))
    assert len(plain) == len(split) == HOT_ROWS + 703
    close(plain, split, names, 1e-7)


def test_running_aggregates_carry_over_chunks(spark, hot, split_groups):
    df, pdf = hot
    df = df.withColumn("gappy", F.when(F.col("seq") % 1500 == 7, F.col("price")))
    spec = {
        "s": ("sum", F.col("volume")),
        "n": ("count", F.col("gappy")),
        "hi": ("max", F.col("price")),
        "lo": ("min", F.col("price")),
        "prev": ("last", F.col("gappy")),
        "nxt": ("next", F.col("gappy")),
    }
    plain = frame(on_series(df, [], running=spec))
    split_groups(BLOCK)
    split = frame(on_series(df, [], running=spec))
    close(plain, split, list(spec), 1e-7)
    want = pdf.sort_values(["symbol", "seq"]).reset_index(drop=True)
    assert np.allclose(plain["s"], want.groupby("symbol")["volume"].cumsum())
    assert np.allclose(plain["hi"], want.groupby("symbol")["price"].cummax())


def test_means_equal_pandas(spark, hot):
    df, pdf = hot
    got = frame(on_series(df, [ind.ema("price", 12, "e"), ind.rsi("price", 14, "r"), ind.adx(14)]))
    for sym, part in pdf.groupby("symbol"):
        g = got[got.symbol == sym].reset_index(drop=True)
        p = part.reset_index(drop=True)
        close(pd.DataFrame({"e": g["e"]}), pd.DataFrame({"e": p.price.ewm(span=12, adjust=False, min_periods=12).mean()}), ["e"])
        d = p.price.diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        dn = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        close(g, pd.DataFrame({"r": 100 - 100 / (1 + up / (dn + 1e-12))}), ["r"])


def test_mean_with_gaps_equals_pandas(spark, hot, split_groups):
    df, pdf = hot
    keep = (pdf.seq % 5 != 0) & (pdf.seq % 997 > 40) & (pdf.seq > 1)
    holes = df.withColumn("price", F.when((F.col("seq") % 5 != 0) & (F.col("seq") % 997 > 40) & (F.col("seq") > 1), F.col("price")))
    steps = [ind.ema("price", n, f"e{n}") for n in (2, 12, 200)] + [ind.rsi("price", 14, "r")]
    plain = frame(on_series(holes, steps))
    for sym, part in pdf.assign(price=pdf.price.where(keep)).groupby("symbol"):
        p = part.reset_index(drop=True)
        g = plain[plain.symbol == sym].reset_index(drop=True)
        for n in (2, 12, 200):
            close(g, pd.DataFrame({f"e{n}": p.price.ewm(span=n, adjust=False, min_periods=n).mean()}), [f"e{n}"], 1e-9)
        d = p.price.diff()
        up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        dn = (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        close(g, pd.DataFrame({"r": 100 - 100 / (1 + up / (dn + 1e-12))}), ["r"], 1e-7)
    split_groups(3 * BLOCK)
    close(plain, frame(on_series(holes, steps)), ["e2", "e12", "e200", "r"], 1e-9)


@pytest.mark.parametrize("rows", [None, 2 * BLOCK])
def test_any_window_length(spark, hot, split_groups, rows):
    df, pdf = hot
    if rows:
        split_groups(rows)
    spans, lengths = (1, 2, 3, 53, 100, 200, 20_000), (2, 27, 50)
    got = frame(on_series(df, [ind.ema("price", n, f"e{n}") for n in spans] + [ind.macd("price", 50, 200, 100)]))
    for sym, part in pdf.groupby("symbol"):
        g, p = got[got.symbol == sym].reset_index(drop=True), part.reset_index(drop=True)
        for n in spans:
            close(g, pd.DataFrame({f"e{n}": p.price.ewm(span=n, adjust=False, min_periods=n).mean()}), [f"e{n}"], 1e-9)
    for n in lengths:
        got = frame(on_series(df, ind.rsi("price", n, "r")))
        p = pdf[pdf.symbol == "hot"].price.reset_index(drop=True)
        d = p.diff()
        up, dn = (x.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for x in (d, -d))
        close(got[got.symbol == "hot"].reset_index(drop=True), pd.DataFrame({"r": 100 - 100 / (1 + up / (dn + 1e-12))}), ["r"], 1e-9)


@pytest.mark.parametrize("rows", [None, 2 * BLOCK])
@pytest.mark.parametrize("noise", [0.01, 0.1, 1.0, 10.0])
def test_filter_of_any_noise_equals_loop(spark, hot, split_groups, noise, rows):
    df, pdf = hot
    if rows:
        split_groups(rows)
    got = frame(on_series(df, ind.kalman(noise=noise)))
    p = pdf[pdf.symbol == "hot"].price.to_numpy()
    state, err, want = p[0], 1.0, [p[0]]
    for z in p[1:]:
        prior = err + 1e-4
        gain = prior / (prior + noise)
        state, err = state + gain * (z - state), prior * (1 - gain)
        want.append(state)
    assert np.allclose(got[got.symbol == "hot"].kalman_price, want, rtol=0, atol=1e-9)


def test_expanding_deviation_keeps_digits_at_a_high_level(spark):
    from barloom.operators.session_features import session_zscore

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": "s", "session_date": pd.Timestamp("2024-01-02").date(), "ts": pd.date_range("2024-01-02", periods=15, freq="min"), "seq": range(15), "x": 1e6 + rng.normal(0, 0.001, 15)})
    got = session_zscore(spark.createDataFrame(pdf), ["x"], keys=("symbol", "session_date"), order=("ts", "seq"), stats=True).toPandas().sort_values("seq")
    want = pdf.x.expanding().std().clip(lower=1e-6)
    assert np.allclose(got.x_std[1:], want[1:], rtol=1e-6)


def test_kalman_equals_loop(spark, hot):
    df, pdf = hot
    got = frame(on_series(df, ind.kalman()))
    p = pdf[pdf.symbol == "mid"].price.to_numpy()
    state, err, want = p[0], 1.0, [p[0]]
    for z in p[1:]:
        err += 1e-4
        gain = err / (err + 0.01)
        state += gain * (z - state)
        err *= 1 - gain
        want.append(state)
    assert np.allclose(got[got.symbol == "mid"].kalman_price, want, atol=1e-9)


def test_entropy_equals_numpy_histogram(spark, hot):
    df, pdf = hot
    got = frame(on_series(df, ind.entropy()))
    p = pdf[pdf.symbol == "mid"].price

    def h(v):
        d, _ = np.histogram(v, bins=10, density=True)
        d = d[d > 0]
        return -(d * np.log2(d)).sum()

    want = np.log(p / p.shift(1)).rolling(20, min_periods=20).apply(h, raw=True)
    close(got[got.symbol == "mid"].reset_index(drop=True), pd.DataFrame({"entropy_20": want.to_numpy()}), ["entropy_20"], 1e-6)


def test_no_look_ahead(spark, hot):
    df, _ = hot
    steps = [ind.sma("price", 14, "a"), ind.ema("price", 26, "b"), ind.bollinger(), ind.kalman()]
    whole = frame(on_series(df, steps))
    part = frame(on_series(df.where("seq < 9000"), steps))
    merged = part.merge(whole, on=["symbol", "seq"], suffixes=("", "_w"))
    for c in ("a", "b", "bb_upper", "kalman_price"):
        assert np.allclose(merged[c], merged[c + "_w"], equal_nan=True)

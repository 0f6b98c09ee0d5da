"""Streams in event-time order: shuffled arrivals over micro-batches equal the batch result; late rows are counted."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import indicators as ind
from barloom.plans.steps import on_series
from barloom.streaming import bars, ordered

COLUMNS = "symbol string, ts timestamp, seq bigint, price double, volume double"


def ticks(rows=400, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "symbol": np.where(np.arange(rows) % 3 == 0, "b", "a"),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 36_000, rows)), unit="s"),
            "seq": np.arange(rows),
            "price": 50 + rng.normal(0, 1, rows).cumsum(),
            "volume": rng.integers(0, 3, rows).astype(float),
        }
    )


def play(spark, folder, parts, build):
    """Write ``parts`` one file each, then drain one file per micro-batch. Returns the rows and the query."""
    for part in parts:
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = bars.tick_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1)
    q = bars.drain(build(stream), f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/rows").toPandas(), q


def heartbeat(at="2024-01-02"):
    return pd.DataFrame({"symbol": ["beat"], "ts": [pd.Timestamp(at)], "seq": [-1], "price": [np.nan], "volume": [np.nan]})


def dealt(pdf, rng, parts=3, late=1500):
    """Rows by arrival, which is up to ``late`` seconds behind their time, each part shuffled."""
    due = pdf.ts + pd.to_timedelta(rng.integers(0, late, len(pdf)), unit="s")
    cut = pd.qcut(due.astype("int64"), parts, labels=False)
    return [pdf[cut == k].sample(frac=1, random_state=k) for k in range(parts)]


@pytest.mark.parametrize("bucket", ["10 minutes", "3 hours"])
def test_recurrences_and_scores_equal_batch(spark, tmp_path, bucket):
    pdf = ticks()
    parts = [*dealt(pdf, np.random.default_rng(1)), heartbeat()]
    kw = {"bucket": bucket, "delay": "40 minutes"}
    got, q = play(spark, str(tmp_path / "r"), parts, lambda s: ordered.stream_recurrences(s, **kw))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4 and ordered.late_rows(q) == 0
    batch = on_series(spark.createDataFrame(pdf), [ind.ema("price", 12, "ema"), ind.rsi("price", 14, "rsi"), ind.kalman()]).toPandas()
    got, want = got.set_index("seq").sort_index(), batch.set_index("seq").sort_index()
    assert got.index.tolist() == want.index.tolist() and (got.symbol == want.symbol).all()
    for c in ("ema", "rsi", "kalman_price"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c

    spread = lambda w: w.max(axis=1) - w.min(axis=1)
    got, _ = play(spark, str(tmp_path / "s"), parts, lambda s: ordered.stream_scores(s, 7, fn=spread, **kw))
    rolled = pdf.groupby("symbol").price.rolling(7)
    want = (rolled.max() - rolled.min()).reset_index(0, drop=True).sort_index()
    assert np.allclose(got.set_index("seq").sort_index()["score"].astype(float), want, equal_nan=True)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    pdf = ticks(60)
    late = pdf[pdf.ts < "2024-01-01 02:00"].head(5).assign(seq=lambda d: d.seq + 1000)
    got, q = play(spark, str(tmp_path), [pdf, heartbeat(), late, heartbeat("2024-01-03")], lambda s: ordered.stream_scores(s, 3, delay="1 minute"))
    assert sorted(got[got.symbol != "beat"].seq) == pdf.seq.tolist() and ordered.late_rows(q) == len(late)


def test_a_silent_feed_is_reported_without_a_trade_of_its_own(spark, tmp_path):
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    row = lambda s, m, v: {"symbol": s, "ts": at(m), "seq": int(m), "price": 1.0, "volume": v}
    first = pd.DataFrame([row("a", 0, 5.0), row("a", 3, 1.0), row("a", 12, 2.0), row("b", 1, 0.0)])
    quotes = pd.DataFrame([row("b", m, 0.0) for m in (20, 40)])  # another feed, no trade at all
    got, _ = play(spark, str(tmp_path / "x"), [first, quotes], lambda s: ordered.stream_stale(s, "5 minutes", bucket="1 minute", delay="1 minute"))
    found = sorted((r.symbol, r.active_from.minute, r.stale_since.minute, r.trades) for r in got.itertuples())
    assert found == [("a", 0, 8, 2), ("a", 12, 17, 1)]

    pdf = ticks(300, 9)
    got, _ = play(spark, str(tmp_path / "y"), [*dealt(pdf, np.random.default_rng(2)), heartbeat()], lambda s: ordered.stream_stale(s, "5 minutes", bucket="7 minutes", delay="30 minutes"))
    want = []
    for symbol, g in pdf[pdf.volume > 0].groupby("symbol"):
        run = (g.ts.diff() >= pd.Timedelta("5 minutes")).cumsum()
        want += [(symbol, r.ts.min(), r.ts.max() + pd.Timedelta("5 minutes"), len(r)) for _, r in g.groupby(run)]
    assert sorted(tuple(r) for r in got.itertuples(index=False)) == sorted(want)

"""What must not grow with the table: plans, estimates, shuffles of a chunked series, rows handed to Python."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.functions.custom import rolling_apply
from barloom.operators import indicators as ind
from barloom.operators import matrix, scaling
from barloom.plans.steps import on_series


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


@pytest.fixture(scope="module")
def ticks(spark):
    n = 12_000
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": np.where(np.arange(n) % 3 > 0, "a", "b"), "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 2) for i in range(n)], "seq": np.arange(n)})
    pdf["price"] = 100 + rng.normal(0, 1, n).cumsum() * 0.1
    pdf["high"], pdf["low"], pdf["volume"] = pdf.price * 1.01, pdf.price * 0.99, rng.integers(1, 90, n).astype(float)
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_estimates_of_pinned_sides_stay_small(spark):
    table = session.durable(spark.range(50).withColumn("x", F.rand(1)))
    for _ in range(10):
        side = session.small_side(table.withColumnRenamed("x", "y"))
        table = session.durable(table.join(side, "id").select("id", "x"))
    assert table.count() == 50
    assert estimate(table) < 1000  # squared in each pass it has thousands of bits


def test_recipe_of_many_passes_is_planned_in_bounded_size(spark, split_groups):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"fold": np.arange(n) % 2, "role": np.where(np.arange(n) % 5 > 0, "train", "val"), "v": rng.exponential(9, n), "d": rng.normal(0, 1, n), "iv": rng.exponential(1, n)})
    df = spark.createDataFrame(pdf)
    whole = scaling.tree_family(df.withColumn("id", F.monotonically_increasing_id()), ["v"], ["d"], ["iv"]).toPandas().sort_values("id")
    split_groups(100)
    out = scaling.tree_family(df.withColumn("id", F.monotonically_increasing_id()), ["v"], ["d"], ["iv"])
    assert estimate(out) < 5000
    got = out.toPandas().sort_values("id")
    for c in ("v", "d", "iv"):
        assert np.allclose(got[c], whole[c], rtol=1e-4, atol=1e-6), c


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning(")


def test_chunked_recurrences_move_the_rows_once(ticks, split_groups):
    split_groups(2048)
    assert exchanges(on_series(ticks, ind.macd()).select("symbol", "seq", "macd_hist")) == 1
    frame = ind.with_indicators(ticks, drop_incomplete=False)
    assert exchanges(frame) <= 2
    assert "SortMergeJoin" not in plan(frame)


def test_chunked_frame_equals_whole_frame(ticks, split_groups):
    whole = ind.with_indicators(ticks, drop_incomplete=False).toPandas().set_index("seq").sort_index()
    split_groups(2048)
    chunked = ind.with_indicators(ticks, drop_incomplete=False).toPandas().set_index("seq").sort_index()
    assert len(whole) == len(chunked) == 12_000
    for c in ind.feature_names():
        assert np.allclose(chunked[c].astype(float), whole[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c


def test_python_functions_get_bounded_groups(ticks, monkeypatch):
    """Groups are within ``barloom.maxGroupRows`` here, but beyond what Python may hold."""
    want = on_series(ticks, rolling_apply("price", 9, np.max, "m")).toPandas().set_index("seq").sort_index().m
    spectra = matrix.map_correlations(ticks, ["price", "volume"], 60, spectrum=True).select("seq", "eigenvalues").toPandas().set_index("seq").sort_index()
    monkeypatch.setattr(session, "PYTHON_ROWS", 2048)
    sizes = on_series(ticks, rolling_apply("price", 9, lambda w: w.max(), "m"))
    assert "_chunk" in plan(sizes)
    got = sizes.toPandas().set_index("seq").sort_index().m
    assert np.allclose(got.astype(float), want.astype(float), equal_nan=True)
    out = matrix.map_correlations(ticks, ["price", "volume"], 60, spectrum=True).select("seq", "eigenvalues")
    assert "_chunk" in plan(out)
    again = out.toPandas().set_index("seq").sort_index()
    assert list(again.index) == list(spectra.index)
    assert np.allclose(np.stack(again.eigenvalues), np.stack(spectra.eigenvalues), atol=1e-9)

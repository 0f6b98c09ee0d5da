"""Correlation matrices, spectra and other cross-sectional matrix features."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import pair_corr
from barloom.plans.steps import Step, on_series
from barloom.plans.timeline import Timeline, lay_out
from barloom.session import durable, python_rows

#: Rows handled at once by the matrix kernels; bounds the memory of a task.
KERNEL_ROWS = 2048


def sample_ends(index: DataFrame, seq_len: int, corr_window: int, horizon: int, pos: str = "end_index") -> DataFrame:
    """Row numbers with enough history behind and ``horizon`` rows ahead."""
    total = index.agg(F.count(F.lit(1)).alias("_n"))
    first = max(seq_len, corr_window) - 1
    ok = (F.col(pos) >= first) & (F.col(pos) < F.col("_n") - horizon)
    return index.crossJoin(F.broadcast(total)).where(ok).drop("_n")


def pair_name(a: str, b: str) -> str:
    return f"corr_{a}__{b}"


def rolling_correlations(wide: DataFrame, names: Sequence[str], n: int = 20, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """One column per pair of a list of nodes, from a wide panel, over the last ``n`` rows.

    A pair that is not finite, or a null in the window, turns the whole matrix of that timestamp into the identity. A series
    without a key is cut into chunks like any other.
    """
    out = map_correlations(wide, names, n, keys, order, holes="identity")
    k = len(names)
    cells = [F.get("corr", F.lit(i * k + j)).alias(pair_name(names[i], names[j])) for i, j in itertools.combinations(range(k), 2)]
    return out.select(*keys, *order, *cells)


def normalised_adjacency(corr: DataFrame, names: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Pair columns to D^-1/2 (A + I) D^-1/2 with A's unit diagonal; also the node degrees."""

    def cell(a: str, b: str) -> Column:
        if a == b:
            return F.lit(2.0)
        return F.col(pair_name(a, b) if names.index(a) < names.index(b) else pair_name(b, a))

    degree = {}
    for a in names:
        total = F.lit(0.0)
        for b in names:
            total = total + cell(a, b)
        degree[f"degree_{a}"] = F.greatest(total, F.lit(eps))
    out = corr.withColumns(degree)
    norm = {f"adj_{a}__{b}": cell(a, b) / F.sqrt(F.col(f"degree_{a}") * F.col(f"degree_{b}")) for i, a in enumerate(names) for b in names[i:]}
    return out.withColumns(norm)


# -- matrices inside tasks -------------------------------------------------------------------------


def _direct(windows: np.ndarray) -> np.ndarray:
    """Co-moments of windows ``(rows, k, n)`` around their own means."""
    centred = windows - windows.mean(axis=2, keepdims=True)
    return np.einsum("rin,rjn->rij", centred, centred)


def _same_run(values: np.ndarray) -> np.ndarray:
    """How many equal values in a row end at each row, per column."""
    rows = np.arange(len(values))[:, None]
    changed = np.ones(values.shape, bool)
    changed[1:] = values[1:] != values[:-1]
    return rows - np.maximum.accumulate(np.where(changed, rows, 0), axis=0) + 1


def rolling_comoments(values: np.ndarray, n: int) -> np.ndarray:
    """(windows, k, k) co-moments of the last ``n`` rows around the window's means, in O(k^2) a row.

    A block of rows is centred on its own mean; running sums and products of its rows are subtracted ``n`` rows apart, and the
    window's mean is taken out. Windows that move too little against their block for that are computed directly.
    """
    rows, k = values.shape
    out = np.empty((max(rows - n + 1, 0), k, k))
    flat = _same_run(values) >= n
    block = max(8 * n, 256)
    for a in range(0, len(out), block):
        b = min(a + block, len(out))
        part = values[a : b + n - 1]
        x = part - part.mean(axis=0)
        sums = np.concatenate([np.zeros((1, k)), np.cumsum(x, axis=0)])
        products = np.concatenate([np.zeros((1, k, k)), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
        s = sums[n:] - sums[:-n]
        own = products[n:] - products[:-n] - s[:, :, None] * s[:, None, :] / n
        still = flat[a + n - 1 : b + n - 1]
        weak = (np.einsum("rii->ri", own) < 1e-7 * np.einsum("ii->i", products[-1])) & ~still
        again = np.flatnonzero(weak.any(axis=1))
        if len(again):
            windows = np.lib.stride_tricks.sliding_window_view(part, n, axis=0)
            own[again] = _direct(windows[again])
        own[still[:, :, None] | still[:, None, :]] = 0.0
        out[a:b] = own
    return out


def _rolling_corr(values: np.ndarray, n: int) -> np.ndarray:
    """(rows, k, k) correlations of the last ``n`` rows, identity where undefined; rows before ``n`` are NaN."""
    rows, k = values.shape
    out = np.full((rows, k, k), np.nan)
    if rows < n:
        return out
    hole = np.isnan(values)
    cov = rolling_comoments(np.where(hole, 0.0, values), n)
    dev = np.sqrt(np.einsum("rii->ri", cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = cov / (dev[:, :, None] * dev[:, None, :])
    seen = np.concatenate([[0], np.cumsum(hole.any(axis=1))])
    corr[~np.isfinite(corr).all(axis=(1, 2)) | (seen[n:] > seen[:-n])] = np.eye(k)
    corr = np.clip(corr, -1.0, 1.0)
    corr[:, np.arange(k), np.arange(k)] = 1.0
    out[n - 1 :] = corr
    return out


def map_correlations(df: DataFrame, cols: Sequence[str], n: int = 60, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), keep: Sequence[str] = (), spectrum: bool = False, holes: str = "zero") -> DataFrame:
    """Rolling correlation matrix of some columns per row as a flat array, or its eigenvalues, descending.

    Each task gets a bounded chunk once (k numbers per row, not a window per row) and builds the matrices in numpy. A null is
    zero, or (``holes="identity"``) makes the windows that hold it the identity.
    """
    cols, name = list(cols), "eigenvalues" if spectrum else "corr"
    rows = df.select(*keys, *order, *keep, *[F.col(c).cast("double").alias(f"_v_{c}") for c in cols])
    # a layout in chunks counts, samples and numbers its input
    tl = lay_out(rows if keys else durable(rows), keys, order, python_rows(df.sparkSession), split=not keys)
    tl = tl.spread(n)
    fields = [tl.df.schema[c] for c in (*keys, *order, *keep)] + [tl.df.schema[f"_v_{c}"] for c in cols]
    schema = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    vs = [f"_v_{c}" for c in cols]

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[vs].to_numpy(dtype="float64")
        values = np.nan_to_num(values) if holes == "zero" else np.where(np.isinf(values), np.nan, values)
        out: list = [None] * len(pdf)
        for a in range(0, max(len(pdf) - n + 1, 0), KERNEL_ROWS):
            corr = _rolling_corr(values[a : a + KERNEL_ROWS + n - 1], n)[n - 1 :]
            cells = np.linalg.eigvalsh(corr)[:, ::-1] if spectrum else corr.reshape(len(corr), -1)
            out[a + n - 1 : a + n - 1 + len(cells)] = list(cells)
        return pdf.assign(**{name: out})

    out = tl.map_chunks(call, schema).where(F.col(name).isNotNull())
    return out.withColumnsRenamed({f"_v_{c}": c for c in cols})


def latest_correlation(df: DataFrame, cols: Sequence[str], n: int = 60, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Correlation matrix of the last ``n`` rows per key as (row_name, col_name, corr)."""
    cols = list(cols)
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    cells = [(a, b) for a in cols for b in cols]
    agg = last.groupBy(*keys).agg(*[pair_corr(F.col(a), F.col(b)).alias(f"_c{i}") for i, (a, b) in enumerate(cells)])
    ok = F.lit(True)
    for i in range(len(cells)):
        ok = ok & F.col(f"_c{i}").isNotNull() & ~F.isnan(f"_c{i}")
    rows = []
    for i, (a, b) in enumerate(cells):
        value = F.lit(1.0) if a == b else F.when(F.col("_ok"), F.greatest(F.least(F.col(f"_c{i}"), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
        rows.append(F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("col_name"), value.alias("corr")))
    return agg.withColumn("_ok", ok).select(*keys, F.inline(F.array(*rows)))


# -- persistence -----------------------------------------------------------------------------------


def hurst(df: DataFrame, x: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), max_lag: int = 20) -> DataFrame:
    """Twice the slope of ln sqrt(deviation of lagged differences) on ln lag; 0.5 for a short series."""
    ks = list(range(2, max_lag))
    step = Step(lambda tl: tl.add({f"_d{k}": F.col(x) - F.lag(x, k).over(tl.over()) for k in ks}), back=max_lag)
    out = on_series(df.select(*keys, *order, x), step, keys, order)
    agg = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in ks])
    logs = F.array(*[F.struct(F.lit(float(np.log(k))).alias("x"), F.ln(F.sqrt(f"_s{k}")).alias("y")) for k in ks])
    points = agg.select(*keys, "_n", F.inline(logs))
    slope = points.groupBy(*keys, "_n").agg(F.regr_slope("y", "x").alias("_b"))
    return slope.select(*keys, F.when(F.col("_n") < 2 * max_lag, 0.5).otherwise(2.0 * F.col("_b")).alias("hurst"))

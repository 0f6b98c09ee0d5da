"""Entry points for the caller's own functions, Arrow-batched."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.steps import TICK_ORDER, Step
from barloom.plans.timeline import Timeline, biggest_group
from barloom.session import max_group_rows, small_side


def rolling_apply(x: str, n: int, fn: Callable[[np.ndarray], float], name: str) -> Step:
    """``fn`` over the last ``n`` values, null until there are as many and where one of them is null.

    A task gets a chunk once and slides a view over it: a value goes to Python once, not once per window.
    """

    def run(tl: Timeline) -> Timeline:
        schema = T.StructType([*tl.df.schema.fields, T.StructField(name, T.DoubleType())])

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_pos", ignore_index=True)
            values = pdf[x].to_numpy("float64")
            out = np.full(len(values), np.nan)
            if len(values) >= n:
                windows = np.lib.stride_tricks.sliding_window_view(values, n)
                whole = np.flatnonzero(~np.isnan(windows).any(axis=1))
                out[whole + n - 1] = [fn(windows[k]) for k in whole]
            return pdf.assign(**{name: out})

        return tl.mapped(call, schema).add({name: F.nanvl(name, F.lit(None).cast("double"))})

    return Step(run, back=n, python=True)


def session_transform(
    df: DataFrame, x: str, name: str, stats: dict[str, Column], fn: Callable[..., pd.Series], keys: Sequence[str] = ("symbol", "session_date")
) -> DataFrame:
    """``fn(x, *stats)`` over Arrow batches, with per-session statistics from built-in aggregates.

    Splitting a group transform this way never gathers a session in one task.
    """
    per = df.groupBy(*keys).agg(*[c.alias(f"_st_{n}") for n, c in stats.items()])

    @F.pandas_udf(T.DoubleType())
    def call(values: pd.Series, *rest: pd.Series) -> pd.Series:
        return fn(values, *rest)

    out = df.join(small_side(per), list(keys))
    return out.withColumn(name, call(F.col(x), *[F.col(f"_st_{n}") for n in stats])).drop(*[f"_st_{n}" for n in stats])


def session_apply(
    df: DataFrame, x: str, name: str, fn: Callable[[pd.Series], pd.Series], keys: Sequence[str] = ("symbol", "session_date"), order: Sequence[str] = TICK_ORDER
) -> DataFrame:
    """``fn`` over each whole session as one series, for functions that need all of it.  The session must fit one task."""
    size, limit = biggest_group(df, keys), max_group_rows(df.sparkSession)
    if size > limit:
        raise ValueError(f"a group of {size} rows exceeds {limit}; split the function into statistics and a row part")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        return pdf.assign(**{name: fn(pdf[x])})

    return df.groupBy(*keys).applyInPandas(call, schema)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Spark SQL has no error function): a series near zero, a continued fraction beyond."""
    a = F.abs(x)
    density = F.exp(-a * a / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    start = F.struct(a.alias("term"), a.alias("sum"))

    def grow(s: Column, k: Column) -> Column:
        term = s["term"] * a * a / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    body = density * F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, grow)["sum"]
    beyond = F.aggregate(F.sequence(F.lit(100), F.lit(1)), a, lambda acc, k: a + k / acc)
    tail = F.when(a < 1.5, 0.5 - body).otherwise(density / beyond)
    return F.when(x < 0, tail).otherwise(1.0 - tail)

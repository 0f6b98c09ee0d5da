"""A step adds columns to a timeline and declares how far it looks back and ahead."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.timeline import Timeline, lay_out
from barloom.session import python_rows

SERIES = ("symbol",)
TICK_ORDER = ("ts", "seq")


@dataclass(frozen=True)
class Step:
    run: Callable[[Timeline], Timeline]
    back: int = 0
    ahead: int = 0
    watch: tuple[str, ...] = ()  # columns of the input that exponential means read
    unbounded: bool = False  # a recurrence: every row depends on all rows before it
    python: bool = False  # hands whole groups to a Python function


def on_series(
    df: DataFrame,
    steps: Step | Iterable[Step],
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = TICK_ORDER,
    running: dict[str, tuple[str, Column]] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Run independent steps over one layout: one count, one shuffle, shared sorts."""
    steps = [steps] if isinstance(steps, Step) else list(steps)
    limit = python_rows(df.sparkSession) if any(s.python for s in steps) else None
    tl = lay_out(df, keys, order, limit, watch=sorted({c for s in steps for c in s.watch}))
    back, ahead = max((s.back for s in steps), default=0), max((s.ahead for s in steps), default=0)
    if running:
        tl = tl.running(running)
    elif not (back or ahead) and any(s.unbounded for s in steps):
        tl = tl.together()
    tl = tl.spread(back, ahead)
    for s in steps:
        tl = s.run(tl)
    return tl.finish(*drop)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(tl: Timeline, agg: Callable[[Column], Column], x: Column, n: int, need: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``need`` (default ``n``) values are present."""
    w = tl.over(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= (n if need is None else need), agg(x).over(w))


@dataclass(frozen=True)
class Mean:
    """Exponential mean without bias correction from row ``start`` on, null until ``need`` values."""

    x: Column
    alpha: float
    start: int = 0
    need: int = 1


@dataclass(frozen=True)
class Recurrence:
    """Columns before, means or linear recurrences, and columns after; several of them share one sweep over the blocks."""

    spec: Callable[[Timeline], dict[str, Mean | tuple[Column | float, Column]]]
    before: Callable[[Timeline], dict[str, Column]] = lambda tl: {}
    after: Callable[[Timeline], dict[str, Column]] = lambda tl: {}


def prepare(tl: Timeline, parts: Sequence[Recurrence]) -> tuple[Timeline, list[Recurrence]]:
    """Add what recurrences read of neighbouring rows and drop the halo, which the recurrences themselves do without."""
    before = {k: v for p in parts for k, v in p.before(tl).items()}
    return tl.add(before).gather(), [replace(p, before=lambda tl: {}) for p in parts]


def sweep(tl: Timeline, parts: Sequence[Recurrence]) -> Timeline:
    """Run recurrences together: scratch columns start with an underscore and are dropped by the caller."""
    before = {k: v for p in parts for k, v in p.before(tl).items()}
    tl = tl.add(before) if before else tl
    spec = {k: v for p in parts for k, v in p.spec(tl).items()}
    means = {k: v for k, v in spec.items() if isinstance(v, Mean)}
    if tl.gappy:
        by_need: dict[int, dict] = {}
        for k, m in means.items():
            by_need.setdefault(m.need, {})[k] = (m.x, m.alpha, m.start)
        for need, cols in by_need.items():
            tl = tl.ewm(cols, need)
        rest = {k: v for k, v in spec.items() if k not in means}
        tl = tl.affine(rest) if rest else tl
    else:
        tl = tl.affine({k: mean_from(tl, v) if k in means else v for k, v in spec.items()})
        tl = tl.add({k: F.when(tl.pos >= m.start + m.need - 1, F.col(k)) for k, m in means.items() if m.need > 1})
    after = {k: v for p in parts for k, v in p.after(tl).items()}
    return tl.add(after) if after else tl


def mean_from(tl: Timeline, m: Mean) -> tuple[float, Column]:
    b = F.when(tl.pos < m.start, 0.0).when(tl.pos == m.start, m.x).otherwise(F.lit(m.alpha) * m.x)
    return math.log1p(-m.alpha) if m.alpha < 1 else -700.0, b

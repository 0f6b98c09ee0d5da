"""Ordered series on Spark, safe for groups of any size.

Almost every operator here looks at neighbouring rows of one series (a symbol, a session, a prediction
log).  A plain ``Window.partitionBy(symbol)`` puts a whole series into one task, which fails as soon as one
symbol holds a large share of the data.  ``lay_out`` therefore counts the groups first (one map-side
combined aggregation on the key columns only) and picks one of two layouts:

* every group is below ``barloom.maxGroupRows``: ordinary windows over the keys;
* some group is larger: rows are range-partitioned by (keys, order), which also splits one hot key, pinned
  by a checkpoint, numbered exactly, and cut into chunks of equal row count per key.  Bounded windows then
  run per (key, chunk) after ``spread`` has copied the edge rows of the neighbouring chunk (the halo), and
  running aggregates get the result of the earlier chunks from a small per-chunk table. The tables of chunks and of partitions
are pinned and broadcast, so that joining them moves no row of the series.

Recurrences (exponential averages, Kalman gains) are linear. Inside a stretch in which the decay stays below
``e^300`` they are running sums of re-weighted values; the stretch before adds its end value, and the one before that
has decayed below double precision by then. A constant decay has stretches of equally many rows, so several columns can
share them; a decay that changes from row to row is cut where its running sum passes the next 300. In the chunked
layout every chunk is an affine map of the value before it, and the maps of a key are chained over the table of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import durable, max_group_rows, small_side

BLOCK = 1024
#: ln of the weight below which an older value no longer changes a double, and of the largest weight in a stretch.
NEGLIGIBLE = 39.2
STRETCH = 300.0

_POS, _CHUNK, _CORE = "_pos", "_chunk", "_core"


@dataclass(frozen=True)
class Timeline:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk_rows: int | None = None
    spread_out: bool = False
    reach: tuple[int, int] = (0, 0)
    gappy: bool = False  # a watched column has nulls: means must look for gaps

    @property
    def chunked(self) -> bool:
        return self.chunk_rows is not None

    @property
    def pos(self) -> Column:
        """0-based row number of the row in its series."""
        return F.col(_POS)

    def _groups(self) -> list[str]:
        return [*self.keys, _CHUNK] if self.chunked else list(self.keys)

    def _sorting(self) -> list[str]:
        return [_POS] if self.chunked else list(self.order)

    def over(self, lo: int | None = None, hi: int | None = 0) -> WindowSpec:
        """Frame of rows ``lo..hi`` around the current row; ``lo=None`` gives the bare ordered window."""
        w = Window.partitionBy(*self._groups()).orderBy(*self._sorting())
        return w if lo is None else w.rowsBetween(lo, hi)

    def add(self, cols: dict[str, Column]) -> Timeline:
        return replace(self, df=self.df.withColumns(cols))

    def spread(self, back: int = 0, ahead: int = 0) -> Timeline:
        """Copy the edge rows that windows of the given reach need into the neighbouring chunks."""
        if not self.chunked or not (back or ahead):
            return self
        size = self.chunk_rows
        at = F.pmod(F.col(_POS), F.lit(size))
        homes = [F.col(_CHUNK)]
        homes += [F.when(at >= k * size - back, F.col(_CHUNK) + k) for k in range(1, math.ceil(back / size) + 1)]
        homes += [
            F.when((at < ahead - (k - 1) * size) & (F.col(_CHUNK) >= k), F.col(_CHUNK) - k)
            for k in range(1, math.ceil(ahead / size) + 1)
        ]
        homes = F.array_compact(F.array(*homes))
        df = (
            self.df.withColumn("_home", F.col(_CHUNK))
            .withColumn(_CHUNK, F.explode(homes))
            .withColumn(_CORE, F.col("_home") == F.col(_CHUNK))
            .drop("_home")
        )
        return replace(self, df=df, spread_out=True, reach=(back, ahead))

    def together(self) -> Timeline:
        """Bring the rows of each chunk together once; windows over stretches of a chunk would be shuffled on their own."""
        return replace(self, df=self.df.repartition(*self._groups())) if self.chunked else self

    def gather(self) -> Timeline:
        """Drop the halo copies again."""
        if not self.spread_out:
            return self
        return replace(self, df=self.df.where(F.col(_CORE)).drop(_CORE), spread_out=False)

    def finish(self, *drop: str) -> DataFrame:
        return self.gather().df.drop(_POS, _CHUNK, *drop)

    def map_chunks(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
        """``fn`` over each bounded chunk in row order (pandas, Arrow batches); halo rows are dropped from its result.

        ``fn`` gets the columns plus ``_pos`` and must keep the row order and count; ``schema`` is its output.
        """
        core, keep = self.spread_out, [f.name for f in schema.fields]

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(_POS, ignore_index=True)
            out = fn(pdf)[keep]
            return out[pdf[_CORE].to_numpy()] if core else out

        return self.df.groupBy(*self._groups()).applyInPandas(call, schema)

    def mapped(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> Timeline:
        """``fn`` over each bounded group of rows, halo rows among them; ``fn`` keeps all columns and adds those of ``schema``."""
        groups = self._groups()
        rows = self.df.groupBy(*groups) if groups else self.df.groupBy()
        return replace(self, df=rows.applyInPandas(fn, schema))

    # -- running aggregates -------------------------------------------------------------------------

    def running(self, cols: dict[str, tuple[str, Column]]) -> Timeline:
        """Unbounded running aggregates; kinds: sum, count, max, min, last, next (first value at or after), before (last value
        of the earlier rows)."""
        if self.spread_out:
            raise ValueError("running aggregates come before spread()")
        df = self.df.withColumns({f"_in_{n}": c for n, (_, c) in cols.items()})
        forward = Window.partitionBy(*self._groups()).orderBy(*self._sorting()).rowsBetween(
            Window.unboundedPreceding, 0
        )
        backward = (
            Window.partitionBy(*self._groups())
            .orderBy(*[F.col(c).desc() for c in self._sorting()])
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        frames = {"next": backward, "before": self.over(Window.unboundedPreceding, -1)}
        local = {n: _fold(kind, F.col(f"_in_{n}")).over(frames.get(kind, forward)) for n, (kind, _) in cols.items()}
        if not self.chunked:
            out = df.withColumns(local)
            return replace(self, df=out.drop(*[f"_in_{n}" for n in cols]))
        parts = df.groupBy(*self.keys, _CHUNK).agg(*[_chunk_total(k, f"_in_{n}").alias(f"_t_{n}") for n, (k, _) in cols.items()])
        before = Window.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.col(_CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = parts.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
            F.col(_CHUNK).alias("_kc"),
            *[
                _fold("sum" if k == "count" else k, F.col(f"_t_{n}")).over(after if k == "next" else before).alias(f"_c_{n}")
                for n, (k, _) in cols.items()
            ],
        )
        same = F.col(_CHUNK) == F.col("_kc")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = df.withColumns({f"_l_{n}": c for n, c in local.items()}).join(small_side(carry), same, "left")
        out = out.withColumns({n: _merge(k, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (k, _) in cols.items()})
        extra = [f"{p}{n}" for n in cols for p in ("_in_", "_l_", "_c_")]
        return replace(self, df=out.drop("_kc", *[f"_k{i}" for i in range(len(self.keys))], *extra))

    # -- linear recurrences -------------------------------------------------------------------------

    def affine(self, cols: dict[str, tuple[Column | float, Column]]) -> Timeline:
        """``y[t] = a[t] * y[t-1] + b[t]`` for several columns; each is ``(ln a, b)``, a Python float being a constant decay.

        ``y`` before the first row is 0; a null ``b`` adds nothing. Any decay will do: below ``e^-700`` it counts as zero.
        """
        if self.spread_out:
            return self.gather().affine(cols).spread(*self.reach)
        cols = {n: (max(a, -700.0) if isinstance(a, float) else a, b) for n, (a, b) in cols.items()}
        out = self._scan(cols)
        if self.chunked:
            out = out._chain(list(cols))
        return out._drop(*[f"_d_{n}" for n in cols])

    def _scan(self, cols: dict[str, tuple[Column | float, Column]]) -> Timeline:
        """The recurrences inside each window group, and the decay since its first row as ``_d_<name>`` (0 or more)."""
        tl = self
        start = F.col(_CHUNK) * self.chunk_rows if self.chunked else F.lit(0)
        by_rows: dict[int, list[str]] = {}
        for n, (log_a, _) in cols.items():
            if isinstance(log_a, float):
                by_rows.setdefault(stretch_rows(log_a), []).append(n)
                tl = tl.add({f"_d_{n}": (F.col(_POS) - start + 1) * F.lit(-log_a)})
            else:
                tl = tl.add({f"_d_{n}": F.sum(F.least(-log_a, F.lit(700.0))).over(tl.over(Window.unboundedPreceding, 0))})
        for rows, names in by_rows.items():
            at = F.pmod(F.col(_POS), F.lit(rows)) + 1
            tl = tl._stretches(F.floor(F.col(_POS) / rows), {n: (at * F.lit(-cols[n][0]), cols[n][1]) for n in names})
        for n, (log_a, b) in cols.items():
            if not isinstance(log_a, float):
                tl = tl._stretches(F.floor(F.col(f"_d_{n}") / STRETCH), {n: (F.col(f"_d_{n}") - F.col("_block") * STRETCH, b)})
        return tl

    def _stretches(self, block: Column, cols: dict[str, tuple[Column, Column]]) -> Timeline:
        """Columns ``(decay since the start of the stretch, b)`` over one division into stretches."""
        df = self.df.withColumn("_block", block)
        inside = Window.partitionBy(*self._groups(), "_block").orderBy(*self._sorting()).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*self._groups()).orderBy("_block", *self._sorting())
        df = df.withColumns({f"_i_{n}": d for n, (d, _) in cols.items()})
        df = df.withColumns({n: F.exp(-F.col(f"_i_{n}")) * F.coalesce(F.sum(b * F.exp(f"_i_{n}")).over(inside), F.lit(0.0)) for n, (_, b) in cols.items()})
        last = {f"_e_{n}": F.lag(F.struct(F.col(n).alias("y"), F.col(f"_d_{n}").alias("d"))).over(before) for n in cols}
        df = df.withColumns(last).withColumns({f"_e_{n}": F.first(f"_e_{n}").over(inside) for n in cols})
        older = {n: F.coalesce(F.col(f"_e_{n}.y") * F.exp(F.col(f"_e_{n}.d") - F.col(f"_d_{n}")), F.lit(0.0)) for n in cols}
        df = df.withColumns({n: F.col(n) + c for n, c in older.items()})
        return replace(self, df=df.drop("_block", *[f"{p}{n}" for n in cols for p in ("_i_", "_e_")]))

    def _chain(self, names: list[str]) -> Timeline:
        """Add what the earlier chunks of a key contribute: each chunk is ``y -> e^-d y + end``."""
        ends = [F.max_by(f"{p}{n}", _POS).alias(f"{p}{n}") for n in names for p in ("", "_d_")]
        parts = self.df.groupBy(*self.keys, _CHUNK).agg(*ends).withColumn(_POS, F.col(_CHUNK))
        step = Timeline(parts.withColumnsRenamed({f"_d_{n}": f"_a_{n}" for n in names}), self.keys, (_CHUNK,))
        step = step._scan({f"_s_{n}": (-F.col(f"_a_{n}"), F.col(n)) for n in names})
        carry = step.df.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], (F.col(_CHUNK) + 1).alias("_kc"), *[f"_s_{n}" for n in names]
        )
        same = F.col(_CHUNK) == F.col("_kc")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = self.df.join(small_side(carry), same, "left")
        out = out.withColumns({n: F.col(n) + F.exp(-F.col(f"_d_{n}")) * F.coalesce(f"_s_{n}", F.lit(0.0)) for n in names})
        return replace(self, df=out.drop("_kc", *[f"_k{i}" for i in range(len(self.keys))], *[f"_s_{n}" for n in names]))

    def ewm(self, cols: dict[str, tuple[Column, float, int]], min_rows: int = 1) -> Timeline:
        """Exponential means without bias correction, per column ``(x, alpha, first row that may have a value)``.

        Where x has nulls, the mean is kept over a gap while the weight of the past decays by the length of the gap, and
        the mean is null until ``min_rows`` values were seen.
        """
        if self.spread_out and self.gappy:
            return self.gather().ewm(cols, min_rows).spread(*self.reach)
        if not self.gappy:
            spec = {}
            for n, (x, alpha, start) in cols.items():
                b = F.when(F.col(_POS) < start, 0.0).when(F.col(_POS) == start, x).otherwise(F.lit(alpha) * x)
                spec[n] = (math.log1p(-alpha) if alpha < 1 else -700.0, b)
            tl = self.affine(spec)
            return tl.add({n: F.when(F.col(_POS) >= start + min_rows - 1, F.col(n)) for n, (_, _, start) in cols.items()})
        tl = self.add({f"_x_{n}": F.when(F.col(_POS) >= start, x) for n, (x, _, start) in cols.items()})
        seen = {f"_g_{n}": ("before", F.when(F.col(f"_x_{n}").isNotNull(), F.col(_POS))) for n in cols}
        counts = {f"_n_{n}": ("count", F.col(f"_x_{n}")) for n in cols}
        tl = tl.running(seen | counts)
        spec = {}
        for n, (_, alpha, _) in cols.items():
            x, gap = F.col(f"_x_{n}"), F.col(_POS) - F.col(f"_g_{n}")
            log_old = gap * F.lit(math.log1p(-alpha) if alpha < 1 else -700.0)
            weight = F.exp(log_old) + alpha
            log_a = F.when(x.isNull() | gap.isNull(), 0.0).otherwise(log_old - F.log(weight))
            b = F.when(x.isNull(), 0.0).when(gap.isNull(), x).otherwise(alpha * x / weight)
            spec[n] = (log_a, b)
        tl = tl.affine(spec)
        tl = tl.add({n: F.when(F.col(f"_n_{n}") >= min_rows, F.col(n)) for n in cols})
        return tl._drop(*[f"{p}{n}" for n in cols for p in ("_x_", "_g_", "_n_")])

    def _drop(self, *names: str) -> Timeline:
        return replace(self, df=self.df.drop(*names))


def stretch_rows(log_a: float) -> int:
    """Rows of a stretch for a constant decay: ``BLOCK`` where that fits, so that columns share it, else a power of two."""
    rows = BLOCK
    while rows * -log_a < NEGLIGIBLE and rows < 1 << 40:
        rows *= 2
    while rows > 1 and rows * -log_a > STRETCH * 2:
        rows //= 2
    return rows


def _fold(kind: str, c: Column) -> Column:
    if kind in ("last", "next", "before"):
        return F.last(c, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c)


def _chunk_total(kind: str, name: str) -> Column:
    c = F.col(name)
    if kind in ("last", "before"):
        return F.max_by(c, F.when(c.isNotNull(), F.col(_POS)))
    if kind == "next":
        return F.min_by(c, F.when(c.isNotNull(), F.col(_POS)))
    return _fold(kind, c)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind in ("last", "next", "before"):
        return F.coalesce(local, carried)
    if kind in ("sum", "count"):
        return F.when(local.isNull(), carried).otherwise(local + F.coalesce(carried, F.lit(0)))
    return F.greatest(local, carried) if kind == "max" else F.least(local, carried)


def biggest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return survey(df, keys)[0]


def survey(df: DataFrame, keys: Sequence[str], watch: Sequence[str] = ()) -> tuple[int, bool]:
    """Rows of the largest group, and whether a watched column has a null: one aggregation over keys and watched columns."""
    hole = F.lit(False)
    for c in watch:
        hole = hole | F.col(c).isNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max(hole).alias("holes"))
    found = counts.agg(F.max("rows"), F.max("holes")).first()
    return int(found[0] or 0), bool(found[1])


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None, watch: Sequence[str] = (), split: bool = False) -> Timeline:
    """Prepare ordered windows over ``keys``; ``order`` must end in a tie-breaker so that it is total.

    ``watch`` names the columns that exponential means read: nulls in them make the means look for gaps. ``split`` cuts groups of
    any size into chunks for all cores.
    """
    keys, order = tuple(keys), tuple(order)
    limit = max_rows or max_group_rows(df.sparkSession)
    rows, holes = survey(df, keys, [c for c in watch if c in df.columns])
    if split:
        limit = min(limit, rows // (2 * df.sparkSession.sparkContext.defaultParallelism))
    elif rows <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        return Timeline(df.withColumn(_POS, F.row_number().over(w) - 1), keys, order, gappy=holes)
    size = max(BLOCK, limit // BLOCK * BLOCK)
    df = number_rows(df, keys, order, _POS)
    return Timeline(df.withColumn(_CHUNK, F.floor(F.col(_POS) / size)), keys, order, chunk_rows=size, gappy=holes)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Exact 0-based row number per key without gathering a key in one task.

    The range partitioning is sampled, so its result is pinned in reliable storage before the partition
    sizes are turned into offsets.
    """
    keys, order = list(keys), list(order)
    pinned = durable(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
        )
    )
    runs = pinned.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_kp"),
        (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_part") == F.col("_kp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = pinned.join(small_side(runs), same).withColumn(name, F.col("_at") + F.col("_shift"))
    return out.drop("_part", "_at", "_kp", "_shift", *[f"_k{i}" for i in range(len(keys))])

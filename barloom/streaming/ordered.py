"""Keyed streaming state over rows in event-time order.

A micro-batch has the rows of a key in any order, and a key may have any number of them. Here rows wait in keyed state by event-time
bucket; when the watermark has passed the end of a bucket, an event-time timer hands its rows, sorted, to a step together
with what the step carried from the bucket before. So a step sees every row once and in order, however the rows were dealt
to micro-batches, and a task holds one bucket of one key. Rows behind the watermark are dropped by Spark; ``late_rows`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.indicators import kalman_gains, span_alpha
from barloom.plans.steps import SERIES
from barloom.streaming.bars import event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``step(key, rows, carried, until)``: sorted rows of a bucket (none in a call that only tells the time), the carried values or
#: None, and the end of the bucket in microseconds. Returns the output rows and the values to carry.
Step = Callable[[tuple, pd.DataFrame, tuple | None, int], tuple[pd.DataFrame | None, tuple]]


class InOrder(StatefulProcessor):
    def __init__(self, step: Step, carried: str, columns: Sequence[str], order: Sequence[str], bucket: int, again: int = 0):
        self.step, self.carried_schema, self.columns, self.order = step, carried, list(columns), list(order)
        self.bucket, self.again = bucket, -(-again // bucket)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket bigint", "rows binary")
        self.carried = handle.getValueState("carried", f"_until bigint, {self.carried_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for bucket, part in frame.groupby(frame["us"] // self.bucket):
                at = (int(bucket),)
                table = pa.Table.from_pandas(part[self.columns], preserve_index=False)
                if self.pending.containsKey(at):
                    table = pa.concat_tables([_read(self.pending.getValue(at)[0]), table], promote_options="permissive")
                else:
                    for later in {0, self.again}:
                        self.handle.registerTimer((at[0] + 1 + later) * self.bucket // 1000)
                self.pending.updateValue(at, (_write(table),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        at = (until // self.bucket - 1,)
        before = self.carried.get() if self.carried.exists() else None
        if before is not None and before[0] > until:
            raise RuntimeError("buckets came out of order")
        if self.pending.containsKey(at):
            rows = _read(self.pending.getValue(at)[0]).to_pandas().sort_values(self.order, ignore_index=True)
            self.pending.removeKey(at)
        else:
            rows = pd.DataFrame({c: [] for c in self.columns})
        out, carried = self.step(key, rows, None if before is None else tuple(before)[1:], until)
        self.carried.update((until, *carried))
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def _write(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def in_order(stream: DataFrame, step: Step, carried: str, output: str, values: Sequence[str], keys: Sequence[str] = SERIES, bucket: str = "1 hour", delay: str = "2 minutes", again: int = 0) -> DataFrame:
    """Run ``step`` over the rows of each key, bucket by bucket; steps see ``us`` (event time in microseconds), ``seq`` and ``values``.

    ``bucket`` is a whole number of milliseconds that timers can name; output comes once the watermark has passed a bucket. With
    ``again`` the step is called once more when so many microseconds have passed after a bucket, whether rows came or not.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    width = pd.Timedelta(bucket) // pd.Timedelta("1us")
    rows = event_time(stream, delay).withColumn("us", F.unix_micros("ts"))
    rows = rows.select(*keys, "ts", "us", "seq", *values)
    processor = InOrder(step, carried, ["us", "seq", *values], ["us", "seq"], int(width), again)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventTime")


def late_rows(query) -> int:
    """Rows that came behind the watermark and were left out, over the progress that the query still reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _times(us: pd.Series) -> pd.Series:
    return pd.to_datetime(us, unit="us", utc=True)


def _row_ids(key: tuple, rows: pd.DataFrame) -> dict:
    return {"symbol": key[0], "ts": _times(rows["us"].astype("int64")), "seq": rows["seq"].astype("int64")}


# -- sliding buffers -------------------------------------------------------------------------------


def stream_scores(ticks: DataFrame, n: int = 10, value: str = "price", fn: Callable[[np.ndarray], np.ndarray] | None = None, **kw) -> DataFrame:
    """``symbol, ts, seq, score``: the score of the last ``n`` values of a symbol, null until the buffer is full.

    ``fn`` maps an array of windows ``(rows, n)`` to scores; the default is their mean. A window with a null has no score.
    """
    score = fn or (lambda windows: windows.mean(axis=1))

    def step(key: tuple, rows: pd.DataFrame, carried: tuple | None, until: int):
        tail = np.array(carried[0] if carried else [], "float64")
        x = np.concatenate([tail, rows[value].to_numpy("float64")])
        out = np.full(len(rows), np.nan)
        if len(x) >= n and len(rows):
            windows = np.lib.stride_tricks.sliding_window_view(x, n)[-len(rows) :]
            whole = ~np.isnan(windows).any(axis=1)
            scores = np.full(len(windows), np.nan)
            if whole.any():
                scores[whole] = score(windows[whole])
            out[len(rows) - len(windows) :] = scores
        frame = pd.DataFrame({**_row_ids(key, rows), "score": out})
        return frame, ([float(v) for v in x[len(x) - min(len(x), n - 1) :]],)

    return in_order(ticks, step, "tail array<double>", "symbol string, ts timestamp, seq bigint, score double", [value], **kw)


# -- recurrences -----------------------------------------------------------------------------------


def _continue(first: float | None, x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean of ``x`` that goes on from ``first`` (or starts with x[0])."""
    if not len(x):
        return x
    series = np.concatenate([[first], x]) if first is not None else x
    out = pd.Series(series).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out[1:] if first is not None else out


def stream_recurrences(ticks: DataFrame, span: int = 12, rsi: int = 14, **kw) -> DataFrame:
    """EMA, RSI and filtered price of every tick; their last values are carried per symbol. Ticks without a price are left out."""
    gains = np.array(kalman_gains())

    def step(key: tuple, rows: pd.DataFrame, carried: tuple | None, until: int):
        rows = rows[rows["price"].notna()]
        n0, price, ema, up, down, kal = carried or (0, None, None, None, None, None)
        if not len(rows):
            return None, (n0, price, ema, up, down, kal)
        x = rows["price"].to_numpy("float64")
        pos = n0 + np.arange(len(x))
        emas = _continue(ema, x, span_alpha(span))
        moves = np.diff(x, prepend=x[0] if price is None else price)
        skip = int(price is None)  # the first tick has no move
        ends = []
        for before, size in ((up, np.maximum(moves, 0.0)), (down, np.maximum(-moves, 0.0))):
            mean = _continue(before, size[skip:], 1.0 / rsi)
            ends.append(np.concatenate([np.full(skip, np.nan), mean]))
        strength = 100.0 - 100.0 / (1.0 + ends[0] / (ends[1] + 1e-12))
        filtered, last = np.empty(len(x)), 0.0 if kal is None else kal
        warm = int(np.clip(len(gains) - n0, 0, len(x)))  # until the gain has settled
        for i in range(warm):
            last += gains[n0 + i] * (x[i] - last)
            filtered[i] = last
        filtered[warm:] = _continue(last, x[warm:], gains[-1])
        known = [None if np.isnan(v[-1]) else float(v[-1]) for v in ends]
        out = pd.DataFrame(
            {
                **_row_ids(key, rows),
                "ema": np.where(pos >= span - 1, emas, np.nan),
                "rsi": np.where(pos >= rsi, strength, np.nan),
                "kalman_price": filtered,
            }
        )
        return out, (int(n0 + len(x)), float(x[-1]), float(emas[-1]), *known, float(filtered[-1]))

    carried = "rows bigint, price double, ema double, up double, down double, kalman double"
    return in_order(ticks, step, carried, "symbol string, ts timestamp, seq bigint, ema double, rsi double, kalman_price double", ["price"], **kw)


# -- duplicates ------------------------------------------------------------------------------------


def stream_first(ticks: DataFrame, values: Sequence[str] = ("price",), **kw) -> DataFrame:
    """``symbol, ts, seq`` and ``values`` of the first tick (least ``seq``) of each symbol and timestamp, whichever arrived first."""

    def step(key: tuple, rows: pd.DataFrame, carried: tuple | None, until: int):
        one = rows.drop_duplicates("us")
        return pd.DataFrame({**_row_ids(key, one), **{c: one[c].astype("float64") for c in values}}), (0,)

    output = "symbol string, ts timestamp, seq bigint, " + ", ".join(f"{c} double" for c in values)
    return in_order(ticks, step, "none int", output, values, **kw)


# -- silences --------------------------------------------------------------------------------------


def stream_stale(ticks: DataFrame, silence: str = "5 minutes", **kw) -> DataFrame:
    """``symbol, active_from, stale_since, trades``: runs of trades (volume above 0) that were followed by ``silence``.

    The watermark comes from all ticks of all symbols, quotes without volume too, so a silent feed is reported by a timer and
    needs no further trade of its own.
    """
    gap = int(pd.Timedelta(silence) // pd.Timedelta("1us"))

    def step(key: tuple, rows: pd.DataFrame, carried: tuple | None, until: int):
        times = rows.loc[rows["volume"] > 0, "us"].to_numpy("int64")
        first, last, n = carried or (None, None, 0)
        if n:
            times = np.concatenate([[last], times])
        runs = np.split(times, np.flatnonzero(np.diff(times) >= gap) + 1) if len(times) else []
        spans = [[int(r[0]), int(r[-1]), len(r)] for r in runs]
        if n:
            spans[0] = [first, spans[0][1], spans[0][2] + n - 1]
        ended = [s for s in spans if s[1] + gap <= until]
        open_ = spans[-1] if spans and spans[-1][1] + gap > until else [None, None, 0]
        out = pd.DataFrame(ended, columns=["active_from", "stale_since", "trades"])
        out["stale_since"] += gap
        out = out.assign(symbol=key[0], active_from=_times(out["active_from"]), stale_since=_times(out["stale_since"]))
        return out[["symbol", "active_from", "stale_since", "trades"]], tuple(open_)

    output = "symbol string, active_from timestamp, stale_since timestamp, trades bigint"
    return in_order(ticks, step, "first bigint, last bigint, trades bigint", output, ["volume"], again=gap, **kw)

"""Steps that need all earlier rows are refused by the buffered stream."""

import pytest

from barloom.operators import indicators as ind
from barloom.streaming import state


def test_buffered_stream_refuses_recurrences(spark, tmp_path):
    steps = [ind.ema("price", 12, "e"), ind.macd(), ind.rsi("price", 14, "r"), ind.stoch_rsi(), ind.atr(14, "a"), ind.keltner(), ind.adx(), ind.kalman(), ind.indicator_frame()]
    for step in steps:
        with pytest.raises(ValueError):
            state.with_history(spark, [ind.sma("price", 3, "s"), step], str(tmp_path))
    state.with_history(spark, [ind.sma("price", 3, "s"), state.stream_buffer("price", 3)], str(tmp_path))

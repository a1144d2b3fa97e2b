"""Streaming forms: bars from late ticks, and an EMA carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a tick stream (symbol, time, seq, price, size); a bar is final once the watermark has passed it."""
    order = F.struct("time", "seq")
    w = ticks.withWatermark("time", late).groupBy("symbol", F.window("time", interval).alias("w"))
    return w.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume")).select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, n: int) -> DataFrame:
    """EMA of a bar stream (symbol, time, close) with the last value as state; rows of a batch are put in order first."""
    import pandas as pd

    alpha = 2 / (n + 1)

    def step(key, frames, state):
        value = state.get[0] if state.exists else None
        for f in frames:
            out = []
            for t, c in f.sort_values("time")[["time", "close"]].itertuples(index=False):
                value = c if value is None else (1 - alpha) * value + alpha * c
                out.append((key[0], t, c, value))
            yield pd.DataFrame(out, columns=["symbol", "time", "close", "ema"])
        if value is not None:
            state.update((float(value),))

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, time timestamp, close double, ema double", "value double", "append", "NoTimeout")


def _kept(bars: DataFrame, keys: list[str], columns: str, state: str, update, start):
    """Rows of a stream with columns made from a state by key. update(state, row) gives (state, new values); rows of a batch
    are put in order of time first, late rows count where they come."""
    import pandas as pd

    names = [c.split()[0] for c in columns.split(", ")]
    given = bars.columns

    def step(key, frames, held):
        value = list(held.get) if held.exists else start()
        for f in frames:
            out = []
            for row in f.sort_values("time").itertuples(index=False):
                value, made = update(value, row)
                out.append((*row, *made))
            yield pd.DataFrame(out, columns=[*given, *names])
        held.update(tuple(value))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in bars.dtypes), columns])
    return bars.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", "NoTimeout")


def stream_rolling(bars: DataFrame, n: int) -> DataFrame:
    """Highest high, lowest low and mean close of the last n bars, null until there are n; the last n bars are the state."""

    def update(state, row):
        high, low, close = (list(x or [])[-(n - 1) :] + [float(v)] if n > 1 else [float(v)] for x, v in zip(state, (row.high, row.low, row.close)))
        full = len(close) == n
        return [high, low, close], (max(high) if full else None, min(low) if full else None, sum(close) / n if full else None)

    return _kept(bars, ["symbol"], "roll_high double, roll_low double, roll_mean double", "high array<double>, low array<double>, close array<double>", update, lambda: [[], [], []])


def stream_session_vwap(bars: DataFrame) -> DataFrame:
    """VWAP from the start of each session (symbol and session are the key, so a session's state ends with it)."""

    def update(state, row):
        value, volume = state[0] + (row.high + row.low + row.close) / 3 * row.volume, state[1] + row.volume
        return [value, volume], (value / volume if volume else None,)

    return _kept(bars, ["symbol", "session"], "vwap double", "value double, volume double", update, lambda: [0.0, 0.0])


def stream_slot_z(bars: DataFrame, value: str, least: int = 30) -> DataFrame:
    """The value against all earlier ones of its slot (symbol and slot are the key), by Welford's sums; null with fewer than `least` of them."""

    def update(state, row):
        n, mean, squares = state
        x = float(getattr(row, value))
        sd = (squares / (n - 1)) ** 0.5 if n > 1 else 0.0
        z = (x - mean) / sd if n >= least and sd > 0 else None
        new = mean + (x - mean) / (n + 1)
        return [n + 1, new, squares + (x - mean) * (x - new)], (z,)

    return _kept(bars, ["symbol", "slot"], "z double", "n long, mean double, squares double", update, lambda: [0, 0.0, 0.0])


def stream_kama(bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman's average; the last n closes and the last value are the state."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def update(state, row):
        closes, last = [*(state[0] or []), float(row.close)][-(n + 1) :], state[1]
        if last is None:
            return [closes, float(row.close)], (float(row.close),)
        path = sum(abs(y - x) for x, y in zip(closes, closes[1:]))
        ratio = abs(closes[-1] - closes[0]) / path if len(closes) == n + 1 and path > 0 else 0.0
        last = last + (ratio * (a - b) + b) ** 2 * (float(row.close) - last)
        return [closes, last], (last,)

    return _kept(bars, ["symbol"], "kama double", "closes array<double>, last double", update, lambda: [[], None])


def stream_trend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    """SuperTrend; the smoothed range, the last close, the line and its side are the state."""

    def update(state, row):
        atr, close, line, up = state
        high, low, c = float(row.high), float(row.low), float(row.close)
        tr = high - low if close is None else max(high - low, abs(high - close), abs(low - close))
        atr = tr if atr is None else atr + (tr - atr) / n
        below, above = (high + low) / 2 - mult * atr, (high + low) / 2 + mult * atr
        if close is None:
            line, up = below, True
        else:
            side = close > line
            if side == up:
                line = max(line, below) if side else min(line, above)
            else:
                line = below if side else above
            up = side
            if (c < line) if up else (c > line):  # the close went through the line
                line, up = (above, False) if up else (below, True)
        return [atr, c, line, up], (line, up)

    return _kept(bars, ["symbol"], "super_trend double, super_trend_up boolean", "atr double, close double, line double, up boolean", update, lambda: [None, None, None, None])


def stream_merged(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream with equal stamps become one, by the rules of merge_duplicate_bars (bars have time and seq); final once the watermark has passed."""
    w = bars.withWatermark("time", late).groupBy("symbol", F.window("time", "1 second").alias("w"))
    return w.agg(F.min_by("open", "seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "seq").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_merged")).select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "n_merged")

"""State machines over one series, in plain pandas: what executors import. No column expressions here."""

from __future__ import annotations

import numpy as np
import pandas as pd

TRADES = "symbol string, cfg string, entry_i long, exit_i long, direction int, entry_px double, exit_px double, pnl double, atr_entry double, mfe double, mae double, pnl_r double, reason string"


def bar_exit(side: int, stop, target, o: float, h: float, lo: float) -> tuple[float, str] | None:
    """Where a bar takes an open position out: at the open beyond a level, else at the level; the stop comes first."""
    beyond = lambda x, level, down: level is not None and (x <= level if down else x >= level)
    down = side > 0
    if beyond(o, stop, down):
        return o, "stop"
    if beyond(o, target, not down):
        return o, "tp"
    if beyond(lo if down else h, stop, down):
        return stop, "stop"
    if beyond(h if down else lo, target, not down):
        return target, "tp"
    return None


def simulate_series(pdf: pd.DataFrame, presets: dict, cost: float) -> pd.DataFrame:
    """All presets of one series in one pass each; entries at the signal bar's close, flat at the last bar of the window."""
    pdf = pdf.sort_values("i")
    rows = pdf[["i", "open", "high", "low", "close", "atr", "long", "short", "in_window", "trend_up"]].to_dict("records")
    ends = [r["in_window"] and (k + 1 == len(rows) or not rows[k + 1]["in_window"]) for k, r in enumerate(rows)]
    out = []
    for cfg, (stop_x, target_x, flip) in presets.items():
        trade = None

        def close(r, price, reason, cfg=cfg):
            pts = (price - trade["px"]) * trade["side"] - cost
            out.append((pdf["symbol"].iloc[0], cfg, trade["i"], r["i"], trade["side"], trade["px"], price, pts, trade["atr"], trade["mfe"], trade["mae"], pts / trade["atr"], reason))

        def enter(r, side, stop_x=stop_x, target_x=target_x):
            reach = lambda x, sign: None if x is None else r["close"] + sign * side * x * r["atr"]
            return {"i": r["i"], "side": side, "px": r["close"], "atr": r["atr"], "mfe": 0.0, "mae": 0.0, "stop": reach(stop_x, -1), "target": reach(target_x, 1)}

        for r, last in zip(rows, ends):
            may = r["atr"] is not None and np.isfinite(r["atr"]) and r["atr"] > 0 and r["in_window"] and not last
            left = False
            if trade:
                side, px = trade["side"], trade["px"]
                trade["mfe"] = max(trade["mfe"], r["high"] - px if side > 0 else px - r["low"])
                trade["mae"] = max(trade["mae"], px - r["low"] if side > 0 else r["high"] - px)
                hit = bar_exit(side, trade["stop"], trade["target"], r["open"], r["high"], r["low"])
                if hit is None and flip and (side > 0) != bool(r["trend_up"]):
                    hit = r["close"], "flip"
                if hit:
                    close(r, *hit)
                    trade, left = None, True
                elif may and (r["short"] if side > 0 else r["long"]):
                    close(r, r["close"], "reverse")
                    trade = enter(r, -side)
                elif last:
                    close(r, r["close"], "flat")
                    trade, left = None, True
            if trade is None and may and not left and (r["long"] or r["short"]):
                trade = enter(r, 1 if r["long"] else -1)
        if trade:
            close(rows[-1], rows[-1]["close"], "end")
    return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])


def trend_step(line: float, up: bool, before: float, close: float, below: float, above: float) -> tuple[float, bool]:
    """The line and its side at a bar, from those at the bar before and the close before: while the side holds, the line does
    not loosen; a side that changed takes its own band; a close through the line changes sides at once."""
    side = before > line
    held = {True: max(line, below), False: min(line, above)}
    fresh = {True: below, False: above}
    now = (held if side == up else fresh)[side]
    through = close < now if side else close > now
    return (fresh[not side], not side) if through else (now, side)


def trend_line(pdf: pd.DataFrame, mult: float) -> pd.DataFrame:
    """The trend line of one series, by trend_step from bar to bar."""
    pdf = pdf.sort_values("i")
    close, mid, reach = pdf["close"].to_numpy(float), (pdf["high"] + pdf["low"]).to_numpy(float) / 2, mult * pdf["atr"].to_numpy(float)
    states = [(float(mid[0] - reach[0]), True)]
    for k in range(1, len(close)):
        states.append(trend_step(*states[-1], close[k - 1], close[k], float(mid[k] - reach[k]), float(mid[k] + reach[k])))
    return pdf[["symbol", "i"]].assign(super_trend=[x for x, _ in states], super_trend_up=[u for _, u in states])

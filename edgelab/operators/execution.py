"""Trades of coarse signals on fine bars with a trailing stop, retests of an opening range, always-in positions, and the search
of an exit grid with its permutation and walk-forward tests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan, sessions, trading
from .windows import lag, series

# ------------------------------------------------------------------ coarse signals on fine bars


def first_bar_from(signals: DataFrame, bars: DataFrame, after: int) -> DataFrame:
    """Adds entry_i: the first bar that starts `after` seconds or more after the signal's stamp; signals beyond the last bar go.

    Both sides are put in one order of time, and each signal takes the next bar behind it: no range join."""
    columns = signals.columns
    marked = signals.select("symbol", (F.col("ts") + after).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bar"), F.struct(*columns).alias("signal"))
    known = bars.select("symbol", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("i").cast("long").alias("bar"), F.lit(None).cast(marked.schema["signal"].dataType).alias("signal"))
    w = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    return marked.unionByName(known).withColumn("entry_i", F.first("bar", ignorenulls=True).over(w)).filter("kind = 0 and entry_i is not null").select("signal.*", "entry_i")


def _one_at_a_time(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of trades in order of entry, those that begin after the last one taken has ended."""
    pdf = pdf.sort_values(["entry_i", "ts"])
    keep, busy = [], -1
    for a, z in zip(pdf["entry_i"], pdf["exit_i"]):
        keep.append(a > busy)
        busy = z if a > busy else busy
    return pdf[keep]


def trailing_trades(signals: DataFrame, bars: DataFrame, after: int, stop: float, target: float, trail_after: float, trail: float, cost: float) -> DataFrame:
    """Trades entered at the close of the first fine bar after each signal, in regular hours, out at the stop, at the trailing stop once the
    trade has been trail_after ahead, at the target, or at the session's last regular close; the stop comes first, and what
    a bar does moves the trail only from the next bar on. One position at a time.

    A short is a long in mirrored prices. The best price before each bar is a running maximum, so the stop of every bar and
    with it the exit of every candidate come from windows over the rest of its session; only candidates, not bars, are taken
    in turn. signals: symbol, ts, direction; bars: symbol, i, ts and prices."""
    x = sessions.with_sessions(bars)
    hours = x.filter("in_rth").select("symbol", "session", "i", "open", "high", "low", "close")
    c = first_bar_from(signals.select("symbol", "ts", "direction"), bars, after)
    c = c.join(x.filter("in_rth").select("symbol", F.col("i").alias("entry_i"), "session", F.col("close").alias("entry_px")), ["symbol", "entry_i"])
    h = c.join(hours, ["symbol", "session"]).filter("i > entry_i")
    d = F.col("direction")
    long = d > 0
    h = h.withColumn("o", F.col("open") * d).withColumn("hi", F.when(long, F.col("high")).otherwise(-F.col("low"))).withColumn("lo", F.when(long, F.col("low")).otherwise(-F.col("high"))).withColumn("c", F.col("close") * d).withColumn("e", F.col("entry_px") * d)
    keys = ("symbol", "ts", "entry_i", "direction")
    w = Window.partitionBy(*keys).orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("best", F.greatest("e", F.coalesce(F.max("hi").over(before), F.col("e")))).withColumn("worst", F.least("e", F.coalesce(F.min("lo").over(before), F.col("e"))))
    h = h.withColumn("armed", F.col("best") - F.col("e") >= trail_after).withColumn("level", F.greatest(F.col("e") - stop, F.when(F.col("armed"), F.col("best") - trail)))
    last = F.lead("i").over(w).isNull()
    goal = F.col("e") + target
    at = lambda px, reason: F.struct(px.alias("px"), reason.alias("reason"))
    trailed = lambda otherwise: F.when(F.col("armed"), "trail").otherwise(otherwise)
    out = F.when(F.col("o") <= F.col("level"), at(F.col("o"), trailed("gap_stop"))).when(F.col("lo") <= F.col("level"), at(F.col("level"), trailed("stop")))
    out = out.when(F.col("hi") >= goal, at(goal, F.lit("target"))).when(last, at(F.col("c"), F.lit("session_close")))
    h = h.withColumn("out", out).filter("out is not null").withColumn("closed", F.col("out.reason") == "session_close")
    best, worst = F.when(F.col("closed"), F.greatest("best", "hi")).otherwise(F.col("best")), F.when(F.col("closed"), F.least("worst", "lo")).otherwise(F.col("worst"))
    first = h.withColumn("n", F.row_number().over(w)).filter("n = 1")
    trades = first.select(*keys, F.col("i").alias("exit_i"), "entry_px", (F.col("out.px") * d).alias("exit_px"), (F.col("out.px") - F.col("e") - cost).alias("pnl"), (best - F.col("e")).alias("mfe"), (F.col("e") - worst).alias("mae"), F.col("out.reason").alias("reason"))
    return trades.groupBy("symbol").applyInPandas(_one_at_a_time, trades.schema)


# ------------------------------------------------------------------ opening-range retests

RETESTS = "symbol string, session string, side int, entry_i long, entry double, stop double, target double, exit_i long, exit double, reason string, r double"


def _retests(pdf: pd.DataFrame) -> pd.DataFrame:
    """The trade of one session and side, in mirrored prices for shorts: a close behind the average near the level, then a close
    back through it, then the first of stop, target and the close of regular hours."""
    pdf = pdf.sort_values("i")
    f, side = pdf.iloc[0], int(pdf["side"].iloc[0])
    level, target = side * f["level"], side * f["target"]
    o, c, mean = (side * pdf[k].to_numpy(float) for k in ("open", "close", "mean"))
    hi, lo = (side * pdf[k].to_numpy(float) for k in (("high", "low") if side > 0 else ("low", "high")))
    minutes, tol = pdf["minutes"].to_numpy(), pdf["tol"].to_numpy(float)
    usable = (minutes >= f["armed"]) & (minutes < sessions.RTH[1]) & np.isfinite(mean) & np.isfinite(tol)
    touch_at = np.flatnonzero(usable & (c < mean) & (np.abs(lo - level) <= tol))
    back_at = np.flatnonzero(usable & (c > mean))
    at = -1
    while True:
        touch = touch_at[touch_at > at]
        back = back_at[back_at > touch[0]] if len(touch) else touch
        if not len(back):
            return pd.DataFrame(columns=[c.split()[0] for c in RETESTS.split(", ")])
        j, stop = back[0], lo[touch[0] : back[0] + 1].min()
        if stop < c[j]:
            break
        at = j  # no room for a stop: look for another touch
    if target <= c[j]:
        return pd.DataFrame(columns=[c.split()[0] for c in RETESTS.split(", ")])
    after = np.arange(j + 1, len(c))
    shut = after[minutes[after] >= sessions.RTH[1]]
    inside = after[: len(after) if not len(shut) else int(np.flatnonzero(after == shut[0])[0])]
    hits = inside[(lo[inside] <= stop) | (hi[inside] >= target)]
    if len(hits):
        k = hits[0]
        px, why = (stop, "stop") if lo[k] <= stop else (target, "target")
    else:
        k, px, why = (shut[0], o[shut[0]], "session_close") if len(shut) else (len(c) - 1, c[-1], "session_close")
    i = pdf["i"].to_numpy()
    row = (f["symbol"], f["session"], side, int(i[j]), side * c[j], side * stop, side * target, int(i[k]), side * px, why, (px - c[j]) / (c[j] - stop))
    return pd.DataFrame([row], columns=[c.split()[0] for c in RETESTS.split(", ")])


def range_retests(fine: DataFrame, middle: DataFrame, coarse: DataFrame, coarse_minutes: int, range_minutes: int = 30, least_range: int = 25, least_before: int = 60, near_atr: float = 0.5, ema_n: int = 20, atr_n: int = 14) -> DataFrame:
    """Breaks of the opening range that are retested and reclaimed, one trade a session and side; the target is the extreme
    from before the open. fine, middle and coarse are bars of one market in three sizes; sessions need so many fine bars in the
    range and before the open. Each session and side is a task of its own."""
    start = sessions.RTH[0]
    x = sessions.with_sessions(fine)
    m = F.col("minutes")
    in_range, before = (m >= start) & (m < start + range_minutes), m < start
    day = x.groupBy("symbol", "session").agg(F.count(F.when(in_range, 1)).alias("n_range"), F.count(F.when(before, 1)).alias("n_before"), *(f(F.when(c, F.col(v))).alias(n) for c, p in ((in_range, "r"), (before, "p")) for f, v, n in ((F.max, "high", f"{p}_high"), (F.min, "low", f"{p}_low"))))
    day = day.filter((F.col("n_range") >= least_range) & (F.col("n_before") >= least_before))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("r_high").alias("level"), F.col("p_high").alias("target")), F.struct(F.lit(-1).alias("side"), F.col("r_low").alias("level"), F.col("p_low").alias("target"))))
    day = day.select("symbol", "session", sides.alias("s")).select("symbol", "session", "s.*").filter("target * side > level * side")
    closes = sessions.with_sessions(coarse).filter((m >= start + range_minutes) & (m < sessions.RTH[1])).join(day, ["symbol", "session"]).filter(F.col("close") * F.col("side") > F.col("level") * F.col("side"))
    armed = closes.groupBy("symbol", "session", "side").agg((F.min_by("minutes", "i") + coarse_minutes).alias("armed"))
    y = scan.scan_many(middle.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))), {"mean": scan.span("close", ema_n), "atr": scan.wilder("tr", atr_n)})
    y = sessions.with_sessions(y.withColumn("tol", near_atr * F.lag("atr").over(series())))
    rows = y.join(day.join(armed, ["symbol", "session", "side"]), ["symbol", "session"]).select("symbol", "session", "side", "i", "minutes", "open", "high", "low", "close", "mean", "tol", "level", "target", "armed")
    return rows.groupBy("symbol", "session", "side").applyInPandas(_retests, RETESTS)


# ------------------------------------------------------------------ always in


def flip_on_cross(bars: DataFrame, fast: int, slow: int, cost: float) -> DataFrame:
    """(symbol, i, session, position, pnl) of a position on the side of the cross in regular hours, flat outside: each bar's
    position earns the next close's difference, and half the cost is paid on the bar where the position changes."""
    x = sessions.with_sessions(scan.scan_many(bars, {"fast": scan.span("close", fast), "slow": scan.span("close", slow)}))
    x = x.withColumn("position", F.when(F.col("in_rth"), F.when(F.col("fast") > F.col("slow"), 1).otherwise(-1)).otherwise(0))
    turn = F.col("position") != F.coalesce(lag("position"), F.lit(0))
    x = x.withColumn("pnl", F.col("position") * (F.lead("close").over(series()) - F.col("close")) - F.when(turn, F.lit(cost / 2)).otherwise(0.0))
    return x.filter("pnl is not null").select("symbol", "i", "session", "position", "pnl")


# ------------------------------------------------------------------ exit grid and its tests


def exit_grid() -> dict[str, tuple]:
    """The 45 exits: six stops by seven targets, and three flips (fixed values)."""
    fixed = {f"s{s:g}t{t or 0:g}": (s, t, False) for s in (2.0, 3.0, 4.0, 5.0, 6.0, 8.0) for t in (None, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)}
    return fixed | {f"flip{s or 0:g}": (s, None, True) for s in (None, 3.0, 6.0)}


def grid_scores(trades: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Trades and profit factor of the bar-by-bar results of each exit. marked: what trading.bar_pnl makes of the trades."""
    per_bar = marked.groupBy(*keys, "cfg", "i").agg(F.sum("pnl").alias("pnl"))
    pf = F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))))
    return trades.groupBy(*keys, "cfg").agg(F.count("*").alias("trades")).join(per_bar.groupBy(*keys, "cfg").agg(pf.alias("profit_factor")), [*keys, "cfg"], "left")


def best_exit(scores: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """The exit with the highest profit factor of those with enough trades; of equal ones the first of the grid."""
    order = {c: k for k, c in enumerate(exit_grid())}
    place = reduce(lambda a, b: a.when(F.col("cfg") == b[0], b[1]), list(order.items())[1:], F.when(F.col("cfg") == next(iter(order)), 0))
    good = scores.filter((F.col("trades") >= least) & F.col("profit_factor").isNotNull())
    return good.groupBy(*keys).agg(F.max_by(F.struct("cfg", "profit_factor", "trades"), F.struct("profit_factor", -place)).alias("b")).select(*keys, "b.*")


def search(features: DataFrame, bars: DataFrame, cost: float, keys: list[str], least: int = 20) -> DataFrame:
    """The best exit of each series; with a draw's number among the keys, of each draw as well."""
    trades = trading.simulate(features, exit_grid(), cost)
    return best_exit(grid_scores(trades, trading.bar_pnl(trades, bars, cost), keys), keys, least)


def walk_forward(features: DataFrame, bars: DataFrame, cost: float, lookback: int, step: int, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(picks, pnl): the exit that was best over the `lookback` bars before each fold, and its bar results over the fold's `step`
    bars. Every fold starts flat, so folds are keys of one simulation: each range of each fold is a series of its own."""
    last = features.groupBy("symbol").agg(F.max("i").alias("last"))
    folds = last.filter(F.col("last") >= lookback).select("symbol", F.posexplode(F.expr(f"sequence({lookback}, last, {step})")).alias("fold", "start"))
    ranges = folds.select("symbol", "fold", F.explode(F.array(F.struct(F.lit("fit").alias("part"), (F.col("start") - lookback).alias("lo"), F.col("start").alias("hi")), F.struct(F.lit("test").alias("part"), F.col("start").alias("lo"), (F.col("start") + step).alias("hi")))).alias("r")).select("symbol", "fold", "r.*")

    def cut(df: DataFrame) -> DataFrame:
        """Rows of each range, under a name of the range in place of the symbol, numbered from its start."""
        x = df.join(ranges, "symbol").filter((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
        return x.withColumn("symbol", F.concat_ws("|", "symbol", F.col("fold").cast("string"), "part")).withColumn("i", F.col("i") - F.col("lo")).drop("fold", "part", "lo", "hi")

    whole, prices = cut(features), cut(bars)
    trades = trading.simulate(whole, exit_grid(), cost)
    marked = trading.bar_pnl(trades, prices, cost)
    name = F.split("symbol", "\\|")
    named = lambda df: df.withColumn("fold", name[1].cast("int")).withColumn("part", name[2]).withColumn("symbol", name[0])
    picks = best_exit(grid_scores(named(trades).filter("part = 'fit'"), named(marked).filter("part = 'fit'"), ["symbol", "fold"]), ["symbol", "fold"], least)
    tests = named(marked).filter("part = 'test'").join(picks.select("symbol", "fold", "cfg"), ["symbol", "fold", "cfg"]).join(folds, ["symbol", "fold"])
    return picks, tests.groupBy("symbol", "fold", (F.col("i") + F.col("start")).alias("i")).agg(F.sum("pnl").alias("pnl"))


def draw_pvalue(scores: DataFrame, keys: list[str], value: str = "profit_factor", draws: int | None = None) -> DataFrame:
    """(keys, real value, p): p = (1 + draws at or above the real market) / (1 + draws). Draws without a value stay in the denominator if `draws` says how many there were."""
    real = scores.filter("perm = 0").select(*keys, F.col(value).alias("real"))
    g = real.join(scores.filter("perm > 0"), keys, "left").groupBy(*keys, "real").agg(F.count(value).alias("n"), F.sum((F.col(value) >= F.col("real")).cast("long")).alias("k"))
    return g.select(*keys, F.col("real").alias(value), ((1 + F.coalesce("k", F.lit(0))) / (1 + (F.lit(draws) if draws else F.col("n")))).alias("p"))

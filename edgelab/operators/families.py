"""Families of configurations as long tables: pairs of averages, cross frequency and cross filters, and their tests against draws."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import conditioners, execution, inference, levels, scan, sessions, signals
from .indicators import wma
from .windows import finite, series, truth

#: Lengths and pairs of the families (fixed values).
FAST, SLOW, VWAP_SLOW = (9, 14, 21, 34, 55), (21, 50, 100, 200), (9, 21, 50, 100, 200)
FREQUENCY_PAIRS, COUNTS = ((8, 21), (10, 29), (20, 50), (50, 200)), (50, 100, 200)
FILTER_PAIRS, WAITS = ((8, 21), (20, 50)), (0, 3, 6)


def pair_family() -> list[tuple[str, str, str]]:
    """(name, fast line, slow line) of 61 pairs; EMA pairs with the fast one first only, as the other way round is the same cross."""
    out = [(f"{kind}{f}/ema{s}", f"{kind}{f}", f"ema{s}") for kind in ("hma", "tema") for f in FAST for s in SLOW]
    out += [(f"vwap/ema{s}", "vwap", f"ema{s}") for s in VWAP_SLOW]
    return out + [(f"ema{f}/ema{s}", f"ema{f}", f"ema{s}") for f in FAST for s in SLOW if f < s]


def average_lines(bars: DataFrame) -> DataFrame:
    """Adds every line that the pairs need: EMAs, TEMAs, Hull averages and the session's VWAP. Three scans make all recurrences."""
    x = sessions.session_vwap(bars).drop("vwap_sd", "minutes", "in_rth", "session")
    emas = sorted({*FAST, *SLOW, *VWAP_SLOW})
    x = scan.scan_many(x, {f"ema{n}": scan.span("close", n) for n in emas})
    x = scan.scan_many(x, {f"e2_{n}": scan.span(f"ema{n}", n) for n in FAST})
    x = scan.scan_many(x, {f"e3_{n}": scan.span(f"e2_{n}", n) for n in FAST})
    for n in FAST:
        x = x.withColumn(f"tema{n}", 3 * (F.col(f"ema{n}") - F.col(f"e2_{n}")) + F.col(f"e3_{n}")).drop(f"e2_{n}", f"e3_{n}")
        x = x.withColumn("hull_raw", 2 * wma("close", max(n // 2, 1)) - wma("close", n)).withColumn(f"hma{n}", wma("hull_raw", max(int(n**0.5), 1))).drop("hull_raw")
    return x


def pair_crosses(bars: DataFrame) -> DataFrame:
    """(bars, cfg, side): crosses of every pair, both lines known here and one bar before."""
    rows = average_lines(bars)
    pairs = F.array(*(F.struct(F.lit(n).alias("cfg"), F.col(f).alias("fast"), F.col(s).alias("slow")) for n, f, s in pair_family()))
    x = rows.select(*bars.columns, F.explode(pairs).alias("p")).select(*bars.columns, "p.*")
    up, down = inference.cross_events(F.col("fast"), F.col("slow"), Window.partitionBy("symbol", "cfg").orderBy("i"))
    return x.withColumn("side", F.when(up, 1).when(down, -1)).filter("side is not null").drop("fast", "slow")


def returns_ahead(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """(symbol, i, horizon, move, up, down) after each bar in its ATRs, null where the series ends; eligible bars alone: regular hours
    with a known ATR. bars have atr."""
    w = lambda h: series().rowsBetween(1, h)
    unit = F.when(F.col("atr") > 0, F.col("atr"))
    parts = []
    for h in horizons:
        whole = F.count("*").over(w(h)) == h
        parts.append(F.struct(F.lit(h).alias("horizon"), ((F.lead("close", h).over(series()) - F.col("close")) / unit).alias("move"), F.when(whole, (F.max("high").over(w(h)) - F.col("close")) / unit).alias("up"), F.when(whole, (F.col("close") - F.min("low").over(w(h))) / unit).alias("down")))
    x = sessions.with_sessions(bars.withColumn("ahead", F.array(*parts))).filter("in_rth and atr > 0")
    return x.select("symbol", "i", F.explode("ahead").alias("a")).select("symbol", "i", "a.*")


def pair_information(bars: DataFrame, horizons: list[int], least: int, keys: list[str] | None = None) -> DataFrame:
    """Welch's t of what follows up and down crosses, for every pair and horizon. bars have atr."""
    events = pair_crosses(bars).select("symbol", "i", "cfg", "side").join(returns_ahead(bars, horizons), ["symbol", "i"])
    return inference.welch(events.withColumn("ret", F.col("move")), "ret", keys or ["symbol", "cfg", "horizon"], least)


def outcomes(rows: DataFrame) -> DataFrame:
    """(rows, outcome, x): return and favourable and adverse excursion in the direction d of each row; higher is better for all."""
    up = F.col("d") > 0
    made = {"ret": F.col("move") * F.col("d"), "mfe": F.when(up, F.col("up")).otherwise(F.col("down")), "mae": -F.when(up, F.col("down")).otherwise(F.col("up"))}
    return rows.withColumn("o", F.explode(F.array(*(F.struct(F.lit(k).alias("outcome"), v.alias("x")) for k, v in made.items())))).select("*", "o.*").drop("o", "move", "up", "down")


def frequency_information(bars: DataFrame, horizons: list[int], pool: int = 150, least: int = 30, frac: float = 0.2, pairs=FREQUENCY_PAIRS, counts=COUNTS) -> DataFrame:
    """Crosses after quiet against those after busy stretches: thirds of the number of crosses before, from the calibration bars.
    A positive t says that quiet ones do better. bars have atr."""
    parts = []
    calib = F.col("i") < F.floor(F.count("*").over(Window.partitionBy("symbol")) * frac)
    for fast, slow in pairs:
        x = signals.ema_pair(bars, fast, slow).withColumn("calib", calib)
        n = F.array(*(F.struct(F.lit(f"ema{fast}-{slow}/K{k}").alias("cfg"), signals.cross_count(k).alias("crosses")) for k in counts))
        x = x.withColumn("counted", n)
        parts.append(x.select("symbol", "i", "calib", "cross", F.col("dir").alias("d"), F.explode("counted").alias("n")).select("symbol", "i", "calib", "cross", "d", "n.*").filter("cross and crosses is not null"))
    x = levels.terciles(reduce(DataFrame.unionByName, parts).withColumn("quiet", -F.col("crosses").cast("double")), "quiet", ["symbol", "cfg"], F.col("calib"), pool)
    x = outcomes(x.filter("side is not null").join(returns_ahead(bars, horizons), ["symbol", "i"]))
    return inference.welch(x, "x", ["cfg", "outcome", "horizon"], least)


def filter_information(bars: DataFrame, raw: DataFrame, horizons: list[int], pool: int = 150, least: int = 30, z_least: int = 30, pairs=FILTER_PAIRS, waits=WAITS) -> DataFrame:
    """Entries some bars after a cross that still holds: top against bottom thirds of each conditioner, thirds of confirmed
    entries in the calibration bars. raw: conditioners.raw_conditioners of the bars."""
    parts = []
    for fast, slow in pairs:
        x = signals.ema_pair(bars, fast, slow)
        for wait in waits:
            parts.append(x.select("symbol", "i", F.lit(f"L{wait}/ema{fast}-{slow}").alias("entry"), signals.confirmed(wait).alias("d"), F.col("dir").alias("state")))
    entries = reduce(DataFrame.unionByName, parts)
    # The z-scores of the composite are those of all bars seen from the entry's side, so they are taken before entries are cut out.
    long = conditioners.conditioned(raw.join(entries.filter("d is not null").select("symbol", "i", "entry", "d").withColumnRenamed("d", "entry_d"), ["symbol", "i"]), F.col("entry_d"), z_least)
    x = levels.terciles(long.select("symbol", "i", "calib", "entry", "d", F.col("cond"), "x"), "x", ["symbol", "entry", "cond"], F.col("calib"), pool).drop("x")
    x = outcomes(x.filter("side is not null").join(returns_ahead(bars, horizons), ["symbol", "i"]))
    return inference.welch(x, "x", ["cond", "entry", "outcome", "horizon"], least)


# ------------------------------------------------------------------ against draws


def named_draws(draws: DataFrame) -> DataFrame:
    """Each draw of each symbol as a series of its own, under the name `draw|symbol`, so that whatever is keyed by symbol takes draws.
    Prices that a price of 0 leaves infinite or undefined are null, so that no comparison holds for them."""
    return draws.withColumns({c: finite(c) for c in ("open", "high", "low", "close") if c in draws.columns}).withColumn("symbol", F.concat_ws("|", F.col("perm").cast("string"), "symbol")).drop("perm")


def with_draw(rows: DataFrame) -> DataFrame:
    """perm and symbol again from such names."""
    parts = F.split("symbol", "\\|", 2)
    return rows.withColumn("perm", parts[0].cast("int")).withColumn("symbol", parts[1])


def against_draws(grouped: DataFrame, statistic: Callable[[DataFrame], DataFrame], perms: int, seed: int = 1) -> DataFrame:
    """A statistic (a function of bars that keeps `symbol` among its keys) of the market and of each draw, in one plan."""
    return with_draw(statistic(named_draws(inference.permuted_bars(grouped, perms, seed))))


def insample_test(grouped: DataFrame, features: Callable[[DataFrame], DataFrame], perms: int, cost: float, least: int = 20, seed: int = 1) -> DataFrame:
    """The best of the exit grid on the market against the best on each draw; draws without a result count as not better."""
    bars = named_draws(inference.permuted_bars(grouped, perms, seed))
    best = with_draw(execution.search(features(bars), bars.select("symbol", "i", "close"), cost, ["symbol"], least))
    return execution.draw_pvalue(best, ["symbol"], draws=perms)


def walk_forward_test(grouped: DataFrame, features: Callable[[DataFrame], DataFrame], perms: int, cost: float, lookback: int, step: int, least: int = 20, seed: int = 1) -> DataFrame:
    """Profit factor of re-optimised exits on the market against draws that differ from it only after the first fit."""
    bars = named_draws(inference.permuted_bars(grouped, perms, seed, start=lookback))
    _, pnl = execution.walk_forward(features(bars), bars.select("symbol", "i", "close"), cost, lookback, step, least)
    factor = F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))))
    return execution.draw_pvalue(with_draw(pnl).groupBy("perm", "symbol").agg(factor.alias("profit_factor")), ["symbol"], draws=perms)


def eligible(bars: DataFrame, warm_up: int) -> Column:
    """Regular hours, past the warm-up, with a known ATR above 0."""
    return truth(F.col("in_rth") & (F.col("i") >= warm_up) & F.col("atr").isNotNull() & ~F.isnan("atr") & (F.col("atr") > 0))


def variance_profile(returns: DataFrame, horizons: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    """Variance ratios over several horizons, with what a move of the horizon carries beyond a random walk's: sigma sqrt(q) (sqrt(vr) - 1)."""
    sigma = returns.groupBy("symbol").agg(F.stddev_samp("r").alias("sigma"))
    parts = [inference.variance_ratio(returns, q).withColumn("q", F.lit(q)) for q in horizons]
    x = reduce(DataFrame.unionByName, parts).join(sigma, "symbol")
    return x.select("symbol", "q", "n", "vr", "m2", F.when(F.col("vr") > 0, F.col("sigma") * F.sqrt("q") * (F.sqrt("vr") - 1)).alias("edge"))


def dominance(splits: DataFrame, all_metrics: DataFrame) -> DataFrame:
    """Does taking the in-sample winner beat taking any: first-order dominance of the winners' results over all results, and the
    area between their distributions (trapezoids between distinct values). splits: oos_metric; all_metrics: oos_metric of every
    configuration in every split. Counts by value are aggregated before they are put in order."""
    count = lambda df, c: df.filter("oos_metric is not null").groupBy("oos_metric").agg(F.count("*").alias(c))
    g = count(splits, "won").join(count(all_metrics, "any"), "oos_metric", "full").select("oos_metric", F.coalesce("won", F.lit(0)).alias("won"), F.coalesce("any", F.lit(0)).alias("any"))
    one = Window.partitionBy(F.lit(1)).orderBy("oos_metric")
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    share = lambda c, w: F.sum(c).over(w) / F.sum(c).over(whole)
    x = g.select("oos_metric", share("won", upto).alias("cw"), share("any", upto).alias("ca"), (F.col("won") / F.sum("won").over(whole)).alias("pw"), (F.col("any") / F.sum("any").over(whole)).alias("pa"))
    # P[winner >= x] - P[any >= x] from the shares up to and at x.
    x = x.withColumn("gap", (1 - F.col("cw") + F.col("pw")) - (1 - F.col("ca") + F.col("pa"))).withColumn("d", F.col("ca") - F.col("cw"))
    x = x.withColumn("area", (F.lead("oos_metric").over(one) - F.col("oos_metric")) * (F.col("d") + F.lead("d").over(one)) / 2)
    return x.agg((F.min("gap") >= -1e-12).alias("never_worse"), (F.max("gap") > 1e-12).alias("sometimes_better"), F.sum("area").alias("area")).select((F.col("never_worse") & F.col("sometimes_better")).alias("dominates"), "area")



"""The indicator menu, signal definitions, line families, crosses and their filters, directional movement, regimes and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .indicators import choppiness, cmo, efficiency_ratio, mid_donchian, with_steps
from .windows import back, full, lag, roll, series, truth

#: Bars a signal looks at: ATRs of the buffer, bars of the slope, bars a side must hold, span of the aligned line (fixed values).
BUFFER, SLOPE, SUSTAIN, ALIGNED = 0.25, 5, 3, 5
#: Line families (fixed values).
MID_LENGTHS = (5, 9, 13, 20, 26, 40, 52, 60, 80, 120)
DISPLACED = [(n, d) for n in (26, 52, 80, 120) for d in (13, 26, 52)]
SPANS = [(t, k, d) for t, k in ((9, 26), (5, 13), (13, 40), (20, 60)) for d in (13, 26, 52)]
LAGGING, EMA_LINES = (13, 26, 52), (9, 26, 52)


def movement(bars: DataFrame) -> DataFrame:
    """Adds step, tr and the directional movements up_move and down_move, 0 on the first bar."""
    up, down = F.coalesce(F.col("high") - lag("high"), F.lit(0.0)), F.coalesce(lag("low") - F.col("low"), F.lit(0.0))
    x = with_steps(bars).withColumn("up_raw", up).withColumn("down_raw", down)
    one = lambda a, b: F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)).otherwise(F.lit(0.0))
    return x.withColumn("up_move", one("up_raw", "down_raw")).withColumn("down_move", one("down_raw", "up_raw")).drop("up_raw", "down_raw")


def wilder_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """ADX and both directional indices by Wilder's smoothing; null before they have n bars."""
    x = scan.scan_many(movement(bars), {c: scan.seeded(v, n) for c, v in (("s_tr", "tr"), ("s_up", "up_move"), ("s_down", "down_move"))})
    ready = F.col("i") >= n - 1
    x = x.withColumn("pdi", F.when(ready, 100 * F.try_divide("s_up", "s_tr"))).withColumn("mdi", F.when(ready, 100 * F.try_divide("s_down", "s_tr")))
    x = x.withColumn("dx", 100 * F.try_divide(F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi")))
    x = scan.scan_many(x, {"adx": scan.seeded("dx", n)}).withColumn("adx", F.when(ready, F.col("adx")))
    return x.select(*bars.columns, "pdi", "mdi", "adx")


def menu(bars: DataFrame) -> DataFrame:
    """(symbol, i, ind, value, ref, atr): each indicator against its reference; bullish is value > ref."""
    n = 10
    change, path = F.abs(F.col("close") - lag("close", n)), F.sum(F.abs(F.col("step"))).over(back(n))
    # Before the n-th bar the ratio counts as 0; on it the change is unknown, and the average stands still.
    sc = lambda er: F.pow(er * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2.0))
    weight = F.when((F.col("i") == n - 1) & (path > 0), F.lit(0.0)).when((F.col("i") < n) | (path <= 0), sc(F.lit(0.0))).otherwise(sc(F.try_divide(change, path)))
    step = F.col("step")
    gain, loss = F.greatest(step, F.lit(0.0)), F.greatest(-step, F.lit(0.0))
    x = movement(bars).withColumn("sc", weight).withColumn("vk", F.coalesce(F.abs(cmo(14)) / 100, F.lit(0.0)) * (2 / 21))
    x = scan.scan_many(x, {
        "kama": scan.smoothing("close", F.col("sc")), "vidya": scan.smoothing("close", F.col("vk")), "gain": scan.wilder(gain, 14), "loss": scan.wilder(loss, 14), "up": scan.wilder("up_move", 14), "down": scan.wilder("down_move", 14), "atr": scan.wilder("tr", 14),
        "m1": scan.wilder("step", 25), "a1": scan.wilder(F.abs(step), 25), "ema20": scan.span("close", 20), "atr20": scan.wilder("tr", 20), "fast": scan.span("close", 12), "slow": scan.span("close", 26),
    })
    x = scan.scan_many(x.withColumn("macd", F.col("fast") - F.col("slow")), {"m2": scan.wilder("m1", 13), "a2": scan.wilder("a1", 13), "signal": scan.span("macd", 9)})
    c, zero = F.col("close"), F.lit(0.0)
    mean, sd = roll(F.avg, "close", 20), roll(F.stddev_samp, "close", 20)
    per = lambda v: F.when(F.col("atr") > 0, 100 * F.try_divide(v, "atr")).otherwise(zero)
    rsi = F.when(F.col("loss") > 0, 100 - 100 / (1 + F.try_divide("gain", "loss"))).otherwise(F.lit(100.0))
    before = lag("close", 10)
    pairs = {
        "kama": (c, F.col("kama")), "vidya": (c, F.col("vidya")), "rsi": (rsi, F.lit(50.0)), "cmo": (F.coalesce(cmo(14), zero), zero), "di": (per("up"), per("down")), "tsi": (F.coalesce(F.when(F.col("a2") > 0, 100 * F.try_divide("m2", "a2")), zero), zero),
        "donchian_mid": (c, mid_donchian(20)), "bollinger_mid": (c, mean), "keltner_mid": (c, F.col("ema20")), "bollinger_pctb": (c - (mean - 2 * sd), mean + 2 * sd - c), "keltner_pos": (c - (F.col("ema20") - 2 * F.col("atr20")), F.col("ema20") + 2 * F.col("atr20") - c),
        "ema": (c, F.col("ema20")), "macd": (F.col("macd"), F.col("signal")), "roc": (F.coalesce(F.when(before > 0, 100 * F.try_divide(c - before, before)), zero), zero),
    }
    rows = x.select("symbol", "i", "atr", F.array(*(F.struct(F.lit(k).alias("ind"), v.cast("double").alias("value"), r.cast("double").alias("ref")) for k, (v, r) in pairs.items())).alias("all"))
    return rows.select("symbol", "i", "atr", F.explode("all").alias("one")).select("symbol", "i", "one.*", "atr")


def signals(menu_rows: DataFrame) -> DataFrame:
    """Six signals of each indicator: 1 bullish, -1 bearish, 0 neither."""
    keys = ("symbol", "ind")
    w = Window.partitionBy(*keys).orderBy("i")
    x = scan.scan_many(menu_rows, {"fast_ref": scan.started("value", ALIGNED, keys)}, keys).withColumn("fast_ref", F.when(F.col("value").isNotNull(), F.col("fast_ref")))
    x = x.withColumn("d", F.col("value") - F.col("ref"))
    x = x.withColumn("prev", F.lag("d").over(w)).withColumn("rise", F.col("ref") - F.lag("ref", SLOPE).over(w)).withColumn("pos", F.coalesce(F.signum("d"), F.lit(0.0)))
    held = w.rowsBetween(-(SUSTAIN - 1), 0)
    whole = F.count("pos").over(held) == SUSTAIN
    side = lambda up, down: F.when(up, 1).when(down, -1).otherwise(0)
    buffered = F.when(F.col("atr") > 0, F.try_divide("d", "atr")).otherwise(F.lit(0.0))
    d, prev = F.col("d"), F.col("prev")
    return x.select(
        *keys, "i", F.col("pos").cast("int").alias("position"), side((d > 0) & (prev <= 0), (d < 0) & (prev >= 0)).alias("fresh"), side((buffered >= BUFFER) & (prev <= 0), (buffered <= -BUFFER) & (prev >= 0)).alias("buffered"),
        side((d > 0) & (F.col("rise") > 0), (d < 0) & (F.col("rise") < 0)).alias("slope"), side(whole & (F.min("pos").over(held) == 1), whole & (F.max("pos").over(held) == -1)).alias("sustained"), F.coalesce(F.signum(F.col("fast_ref") - F.col("ref")).cast("int"), F.lit(0)).alias("aligned"),
    )


def cloud_lines(bars: DataFrame) -> DataFrame:
    """(bars, cfg, line): the 40 lines, middles of channels, displaced ones, spans of two, lagging closes and EMAs."""
    x = reduce(lambda a, n: a.withColumn(f"mid{n}", mid_donchian(n)), MID_LENGTHS, bars)
    x = scan.scan_many(x, {f"ema{n}": scan.span("close", n) for n in EMA_LINES})
    lines = {f"mid({n})": F.col(f"mid{n}") for n in MID_LENGTHS}
    lines |= {f"middisp({n},{d})": lag(f"mid{n}", d) for n, d in DISPLACED}
    lines |= {f"span({t},{k},{d})": lag((F.col(f"mid{t}") + F.col(f"mid{k}")) / 2, d) for t, k, d in SPANS}
    lines |= {f"chikou({n})": lag("close", n) for n in LAGGING} | {f"ema({n})": F.col(f"ema{n}") for n in EMA_LINES}
    rows = x.select(*bars.columns, F.array(*(F.struct(F.lit(k).alias("cfg"), v.alias("line")) for k, v in lines.items())).alias("all"))
    return rows.select(*bars.columns, F.explode("all").alias("one")).select(*bars.columns, "one.*")


def line_crosses(lines: DataFrame, keys: tuple[str, ...] = ("symbol", "cfg")) -> DataFrame:
    """Adds side: 1 where the close crosses above its line, -1 below, null elsewhere; the line is known here and one bar before."""
    w = Window.partitionBy(*keys).orderBy("i")
    x = lines.withColumn("above", truth(F.col("close") > F.col("line"))).withColumn("known", F.col("line").isNotNull() & F.lag("line").over(w).isNotNull())
    was = F.coalesce(F.lag("above").over(w), F.lit(False))
    return x.withColumn("side", F.when(F.col("known") & F.col("above") & ~was, 1).when(F.col("known") & ~F.col("above") & was, -1)).drop("above", "known")


def ema_pair(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Adds fast, slow, dir (1 while fast is above slow, else -1) and cross: the state differs from the bar before."""
    x = scan.scan_many(bars, {"fast": scan.span("close", fast), "slow": scan.span("close", slow)})
    x = x.withColumn("dir", F.when(F.col("fast") > F.col("slow"), 1).otherwise(-1))
    return x.withColumn("cross", truth(F.col("dir") != lag("dir")))


def strict_crosses(fast: Column, slow: Column) -> Column:
    """1 where the difference leaves zero or below for above, -1 the other way; a touch of zero is on neither side."""
    d = fast - slow
    before = F.lag(d).over(series())
    return F.when((d > 0) & (before <= 0), 1).when((d < 0) & (before >= 0), -1)


def cross_count(window: int) -> Column:
    """Crosses in the `window` bars before this one; null until there are so many."""
    w = series().rowsBetween(-window, -1)
    return F.when(F.count("cross").over(w) == window, F.sum(F.col("cross").cast("long")).over(w))


def confirmed(wait: int) -> Column:
    """Side of an entry `wait` bars after a cross whose state still holds here; null elsewhere. The first bar's state counts as a cross up if it is up."""
    up = (F.col("dir") == 1) & (F.coalesce(lag("dir"), F.lit(-1)) == -1)
    down = (F.col("dir") == -1) & (lag("dir") == 1)
    then = F.when(up, 1).when(down, -1)
    return F.when(F.lag(then, wait).over(series()) == F.col("dir"), F.col("dir"))


def separated(crosses: DataFrame, least: float, most_wait: int = 12) -> DataFrame:
    """Adds sep (distance of the lines in ATRs) and entry: for each cross the first bar at most most_wait bars on whose sep is
    `least` or more, taken only if the cross's side still holds there, which uses the cross up either way. Needs atr, fast, slow, dir.
    A cross's group ends with the next cross, so within it the side holds by itself."""
    x = crosses.withColumn("sep", F.abs(F.col("fast") - F.col("slow")) / F.when(F.col("atr") > 0, F.col("atr")))
    first = (F.col("dir") == 1) & lag("dir").isNull()
    x = x.withColumn("group", F.sum((F.col("cross") | first).cast("long")).over(series()))
    g = Window.partitionBy("symbol", "group")
    age = F.col("i") - F.min("i").over(g)
    x = x.withColumn("fits", (F.col("group") > 0) & (age <= most_wait) & truth(F.col("sep") >= least))
    return x.withColumn("entry", F.when(F.col("fits") & (F.col("i") == F.min(F.when(F.col("fits"), F.col("i"))).over(g)), F.col("dir"))).drop("fits")


def regime(bars: DataFrame) -> DataFrame:
    """Adds regime: 1 up-trend, -1 down-trend, 0 chop, 2 neither; each must hold for three bars, and chop yields to trends.
    Limits are fixed values: efficiency .35 and .20, ADX 30 and 23, choppiness 45 and 55."""
    x = with_steps(wilder_adx(bars, 14)).withColumn("er", efficiency_ratio(10)).withColumn("ser", efficiency_ratio(10, True)).withColumn("chop", choppiness(14))
    three = lambda c: F.count("i").over(back(3)) + F.min(truth(c).cast("int")).over(back(3)) == 4
    trend = lambda a, b: (F.col("er") > 0.35) & (F.col("adx") > 30) & (F.col(a) > F.col(b)) & (F.col("chop") < 45)
    x = x.withColumn("is_up", three(trend("pdi", "mdi"))).withColumn("is_down", three(trend("mdi", "pdi"))).withColumn("is_chop", three(truth(F.abs("ser") < 0.20) | truth(F.col("chop") > 55) | truth(F.col("adx") < 23)))
    return x.select(*bars.columns, "er", "ser", "chop", "pdi", "mdi", "adx", F.when(F.col("is_up"), 1).when(F.col("is_down"), -1).when(F.col("is_chop"), 0).otherwise(2).alias("regime"))


def base_entries(bars: DataFrame) -> DataFrame:
    """Adds long (close above the middle of 9 bars and above that of 52 bars displaced by 26) and short (TEMA 14 below EMA 20
    below VWMA 12, and the close below the displaced middle)."""
    x = scan.scan_many(bars, {"e1": scan.span("close", 14), "ema20": scan.span("close", 20)})
    x = scan.scan_many(scan.scan_many(x, {"e2": scan.span("e1", 14)}), {"e3": scan.span("e2", 14)})
    vwma = full(F.try_divide(F.sum(F.col("close") * F.col("volume")).over(back(12)), F.sum("volume").over(back(12))), "close", 12)
    x = x.withColumn("mid9", mid_donchian(9)).withColumn("mid52", mid_donchian(52)).withColumn("line", lag("mid52", 26)).withColumn("vwma", vwma)
    tema = 3 * (F.col("e1") - F.col("e2")) + F.col("e3")
    long = truth((F.col("close") > F.col("mid9")) & (F.col("close") > F.col("line")))
    short = truth((tema < F.col("ema20")) & (F.col("ema20") < F.col("vwma")) & (F.col("close") < F.col("line")))
    return x.select(*bars.columns, long.alias("long"), short.alias("short"))


def accuracy(calls: DataFrame, horizons: list[int], start: int, keys: list[str]) -> DataFrame:
    """Share of right directions, of bars with a call, and of rises, over samples that do not overlap: every n-th bar from
    `start` on that has n bars after it. calls: (keys, symbol, i, call, close)."""
    w = Window.partitionBy(*keys).orderBy("i")
    last = F.max("i").over(Window.partitionBy(*keys))
    x = calls.withColumn("last", last).withColumn("n", F.explode(F.array(*map(F.lit, horizons))))
    future = reduce(lambda a, n: F.when(F.col("n") == n, F.lead("close", n).over(Window.partitionBy(*keys, "n").orderBy("i"))).otherwise(a), horizons, F.lit(None).cast("double"))
    x = x.withColumn("move", F.signum(future - F.col("close"))).filter((F.col("i") >= start) & ((F.col("i") - start) % F.col("n") == 0) & (F.col("i") < F.col("last") + 1 - F.col("n")))
    called = (F.col("call") != 0) & (F.col("move") != 0)
    return x.groupBy(*keys, "n").agg(F.count("*").alias("samples"), F.sum(called.cast("long")).alias("called"), F.avg(F.when(called, (F.col("call") == F.col("move")).cast("int"))).alias("accuracy"), F.avg((F.col("move") > 0).cast("int")).alias("base_rate"))

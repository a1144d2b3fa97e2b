"""Volume profiles, price levels of sessions, breaks and their acceptance, anchors, touches and races in long form.

Events carry their band, side and group as columns, so that a whole family of races is one plan."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sessions
from .windows import full, series, truth

ANCHORS = ("ny", "session", "continuous", "weekly", "monthly", "quarterly")
LEVELS = ("pd_poc", "pd_vah", "pd_val", "hvn", "lvn", "vwap", "vwap_u1", "vwap_d1", "or_hi", "or_lo", "swing_hi", "swing_lo", "rand")
#: Parts of the day in minutes; a start after its end wraps past midnight (fixed values).
BUCKETS = {"or": (510, 540), "post_or": (540, 570), "post_ib": (570, 660), "midday": (660, 780), "pm": (780, 900), "evening": (1020, 1140), "asia": (1140, 120), "london": (120, 510)}
DIGITS = 9


def anchor_key(kind: str) -> Column:
    """The period that a bar belongs to."""
    session = sessions.local() + F.expr("interval 7 hours")
    return {
        "continuous": F.lit("all"), "ny": F.date_format(sessions.local() - F.expr("interval 510 minutes"), "yyyyMMdd"), "session": F.date_format(session, "yyyyMMdd"), "monthly": F.date_format(session, "yyyyMM"),
        "weekly": F.concat(F.extract(F.lit("YEAROFWEEK"), session).cast("string"), F.lit("W"), F.lpad(F.weekofyear(session).cast("string"), 2, "0")), "quarterly": F.concat(F.year(session).cast("string"), F.lit("Q"), F.quarter(session).cast("string")),
    }[kind]


def anchored_bands(bars: DataFrame, kinds: tuple[str, ...] = ANCHORS, least_age: int = 5) -> DataFrame:
    """(bars, sessions, kind, anchor, age, mu, sigma, zone): bands of each kind of anchor from the bars before, in long form."""
    x = sessions.with_sessions(bars).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    x = x.withColumn("a", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), anchor_key(k).alias("anchor")) for k in kinds)))).select("*", "a.*").drop("a")
    w = Window.partitionBy("symbol", "kind", "anchor").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("base", F.first("tp").over(w)).withColumn("age", F.row_number().over(w).cast("long") - 1)
    y, v = F.col("tp") - F.col("base"), F.col("volume")
    x = x.withColumn("m1", F.try_divide(F.sum(y * v).over(before), F.sum(v).over(before))).withColumn("m2", F.try_divide(F.sum(y * y * v).over(before), F.sum(v).over(before)))
    var = F.col("m2") - F.col("m1") * F.col("m1")
    ok = (F.col("age") >= least_age) & (var > 1e-9)
    x = x.withColumn("mu", F.when(ok, F.col("base") + F.col("m1"))).withColumn("sigma", F.when(ok, F.sqrt(var)))
    return x.withColumn("zone", F.coalesce(F.try_divide(F.col("close") - F.col("mu"), F.col("sigma")), F.lit(0.0)).cast("int")).drop("tp", "base", "m1", "m2")


def touches(banded: DataFrame, bands: tuple[int, ...], signs: tuple[int, ...] = (-1, 1), per: tuple[str, ...] = ("session",), condition: Column | None = None) -> DataFrame:
    """The first bar of each period that reaches the band k deviations away on the side `sign`, for all k and sign at once.
    beyond: it also closes beyond the band."""
    sides = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("sign")) for k in bands for s in signs))
    x = banded.withColumn("b", F.explode(sides)).select("*", "b.*").drop("b")
    band, up = F.col("mu") + F.col("sign") * F.col("k") * F.col("sigma"), F.col("sign") > 0
    x = x.filter(truth(F.when(up, F.col("high") >= band).otherwise(F.col("low") <= band))).withColumn("beyond", F.when(up, F.col("close") > band).otherwise(F.col("close") < band))
    if condition is not None:
        x = x.filter(condition)
    rank = F.row_number().over(Window.partitionBy("symbol", "kind", *per, "k", "sign").orderBy("i"))
    return x.withColumn("rank", rank).filter("rank = 1").drop("rank")


def race_events(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Adds to each event with a whole horizon what came first within it: a_win, a_loss, tie, b_win, b_loss, c_win, c_loss.

    A: the mean against one band further out; B: after the mean, the mirror band against the band further out; C: the mirror
    band against the band further out. Levels are those of the event; ties are losses. Bars ahead are gathered by a frame
    of `horizon` rows on the bars, once, and not by a join for each event."""
    ahead = series().rowsBetween(1, horizon)
    paths = bars.select("symbol", "i", F.collect_list(F.struct("high", "low")).over(ahead).alias("path")).filter(F.size("path") == horizon)
    x = events.join(paths, ["symbol", "i"])
    up = F.col("sign") < 0
    mean, ext, mirror = F.col("mu"), F.col("mu") + F.col("sign") * (F.col("k") + 1) * F.col("sigma"), F.col("mu") - F.col("sign") * F.col("k") * F.col("sigma")
    x = x.withColumn("to_mean", mean).withColumn("to_ext", ext).withColumn("to_mirror", mirror).withColumn("up", up)
    never = F.lit(1 << 30)

    def hits(level: str, adverse: bool) -> Column:
        """Places in the path that reach a level: toward the mean, or away from it."""
        test = lambda b: F.when(F.col("up") != F.lit(adverse), b["high"] >= F.col(level)).otherwise(b["low"] <= F.col(level))
        return F.filter(F.transform("path", lambda b, n: F.when(test(b), n)), lambda n: n.isNotNull())

    first = lambda places: F.coalesce(F.array_min(places), never)
    x = x.withColumn("ext_at", hits("to_ext", True)).withColumn("mirror_at", hits("to_mirror", False)).withColumn("t", first(hits("to_mean", False)))
    x = x.withColumn("x", first(F.col("ext_at"))).withColumn("o", first(F.col("mirror_at"))).withColumn("x2", first(F.filter("ext_at", lambda n: n > F.col("t")))).withColumn("o2", first(F.filter("mirror_at", lambda n: n > F.col("t"))))
    t, e, o, e2, o2 = (F.col(c) for c in ("t", "x", "o", "x2", "o2"))
    a_win = t < e
    return x.select(*events.columns, a_win.alias("a_win"), ((e < never) & (e <= t)).alias("a_loss"), ((t < never) & (t == e)).alias("tie"), (a_win & (o2 < e2)).alias("b_win"), (a_win & (e2 < never) & (e2 <= o2)).alias("b_loss"), (o < e).alias("c_win"), ((e < never) & (e <= o)).alias("c_loss"))


def race_table(raced: DataFrame, by: list[str], cost: float = 0.0) -> DataFrame:
    """Counts and chances by group, with the races' geometry from the close of the touch: distances to the mean and to the
    next band in deviations, and the chance of A that breaks even after the cost."""
    n = lambda c: F.sum(c.cast("long"))
    to_mean = F.abs(F.col("mu") - F.col("close")) / F.col("sigma")
    to_ext = F.abs(F.col("close") - (F.col("mu") + F.col("sign") * (F.col("k") + 1) * F.col("sigma"))) / F.col("sigma")
    even = F.try_divide(to_ext * F.col("sigma") + cost, (to_mean + to_ext) * F.col("sigma"))
    g = raced.groupBy(*by).agg(F.count("*").alias("n"), *(n(F.col(f"{r}_win") | F.col(f"{r}_loss")).alias(f"n{r.upper()}") for r in "abc"), *(n(F.col(f"{r}_win")).alias(f"{r}_won") for r in "abc"), n(F.col("tie")).alias("ties"), F.avg(to_mean).alias("d_mean"), F.avg(to_ext).alias("d_ext"), F.avg("sigma").alias("sigma"), F.avg(even).alias("pA_even"))
    return g.select(*by, "n", "nA", "nB", "nC", *(F.try_divide(f"{r}_won", f"n{r.upper()}").alias(f"p{r.upper()}") for r in "abc"), (1 - F.col("nA") / F.col("n")).alias("unresolved"), (F.col("ties") / F.col("n")).alias("ambiguous"), "d_mean", "d_ext", "sigma", "pA_even")


def bucket_of(minutes: Column) -> Column:
    """Names of the parts of the day that the minute lies in, as an array."""
    return F.array_compact(F.array(*(F.when(sessions.in_clock_bucket(minutes, a, b), F.lit(k)) for k, (a, b) in BUCKETS.items())))


def band_economics(table: DataFrame, cost: float, most_unresolved: float = 0.35) -> DataFrame:
    """Expected points of reverting and of extending at each band, for cells that resolve often enough."""
    back, out = F.col("d_mean") * F.col("sigma"), F.col("d_ext") * F.col("sigma")
    revert = F.col("pA") * back - (1 - F.col("pA")) * out - cost
    extend = (1 - F.col("pA")) * out - F.col("pA") * back - cost
    x = table.filter(F.col("unresolved") <= most_unresolved).withColumn("band", F.col("k") * F.col("sign")).withColumn("ev_revert", revert).withColumn("ev_extend", extend).withColumn("even_extend", F.try_divide(back + cost, back + out))
    return x.withColumn("ev_best", F.greatest("ev_revert", "ev_extend")).withColumn("side", F.when(F.col("ev_extend") > F.col("ev_revert"), "extend").otherwise("revert"))


def band_profile(economics: DataFrame) -> DataFrame:
    """Cells of each signed band together: races, mean chance and value, the side most of them favour (of equal ones the first by name)."""
    sides = economics.groupBy("band", "side").agg(F.count("*").alias("c")).groupBy("band").agg(F.min_by("side", F.struct(-F.col("c"), "side")).alias("usual_side"))
    g = economics.groupBy("band").agg(F.count("*").alias("cells"), F.countDistinct("kind").alias("kinds"), F.sum("nA").alias("races"), F.avg("pA").alias("pA"), F.avg("ev_best").alias("ev_best"))
    return g.join(sides, "band")


def touch_then_cross(events: DataFrame, bars: DataFrame, cross: Column, wait: int, horizons: list[int]) -> DataFrame:
    """What follows touches after which the fast line crosses back within `wait` bars (A, from the cross), those without
    (B, from the end of the wait), and such crosses anywhere (C), in ATRs, signed so that a way back is a gain. bars have atr."""
    longest, ordered = max(horizons), series()
    later = F.collect_list(F.struct("i", "crossed", "close", "atr", *(f"f{h}" for h in horizons))).over(ordered.rowsBetween(1, wait))
    x = bars.withColumn("crossed", F.coalesce(cross, F.lit(0)))
    for h in horizons:
        x = x.withColumn(f"f{h}", (F.lead("close", h).over(ordered) - F.col("close")) / F.when(F.col("atr") > 0, F.col("atr")))
    x = x.withColumn("later", later).withColumn("left", F.count("*").over(ordered.rowsBetween(1, wait + longest)))
    e = events.select("symbol", "i", "k", "sign").join(x.select("symbol", "i", "later", "left"), ["symbol", "i"]).filter(F.col("left") == wait + longest)
    hit = F.get(F.filter("later", lambda b: b["crossed"] == -F.col("sign")), F.lit(0))
    at = F.coalesce(hit, F.element_at("later", -1))
    returns = lambda row, arm: F.explode(F.array(*(F.struct(arm.alias("arm"), F.lit(h).alias("horizon"), (-F.col("sign") * row[f"f{h}"]).alias("ret")) for h in horizons)))
    ab = e.withColumn("row", at).withColumn("arm", F.when(hit.isNotNull(), "A").otherwise("B")).select("symbol", "k", "sign", returns(F.col("row"), F.col("arm")).alias("r")).select("symbol", "k", "sign", "r.*")
    c = x.filter("crossed <> 0").withColumn("sign", -F.col("crossed")).withColumn("row", F.struct(*(f"f{h}" for h in horizons)))
    c = c.join(events.select("symbol", "k", "sign").distinct(), ["symbol", "sign"]).select("symbol", "k", "sign", returns(F.col("row"), F.lit("C")).alias("r")).select("symbol", "k", "sign", "r.*")
    g = ab.unionByName(c).filter("ret is not null").groupBy("symbol", "k", "sign", "horizon").agg(*(F.count(F.when(F.col("arm") == a, 1)).alias(f"n{a}") for a in "ABC"), *(F.avg(F.when(F.col("arm") == a, F.col("ret"))).alias(f"m{a}") for a in "ABC"))
    return g.select("*", (F.col("mA") - F.col("mB")).alias("dA_B"), (F.col("mA") - F.col("mC")).alias("dA_C"))


# ------------------------------------------------------------------ profiles and levels


def bar_profile(bars: DataFrame, tick: float, least_bars: int = 8) -> DataFrame:
    """(symbol, session, level, vol): each regular-hours bar's volume spread evenly over the levels of its range; levels
    without volume between a session's ends are there with 0. Sessions with fewer than least_bars such bars are left out."""
    x = sessions.with_sessions(bars).filter("in_rth").withColumn("lo", F.floor(F.col("low") / tick)).withColumn("hi", F.ceil(F.col("high") / tick))
    spread = x.select("symbol", "session", F.explode(F.sequence("lo", "hi")).alias("level"), (F.col("volume") / (F.col("hi") - F.col("lo") + 1)).alias("part")).groupBy("symbol", "session", "level").agg(F.sum("part").alias("vol"))
    ends = x.groupBy("symbol", "session").agg(F.count("*").alias("bars"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("bars") >= least_bars)
    grid = ends.select("symbol", "session", F.explode(F.sequence("lo", "hi")).alias("level"))
    return grid.join(spread, ["symbol", "session", "level"], "left").withColumn("vol", F.round(F.coalesce("vol", F.lit(0.0)), DIGITS))


def profile_levels(profile: DataFrame, tick: float, share: float = 0.7) -> DataFrame:
    """Point of control (the lowest of equal ones), value area of the heaviest levels, and the nearest high- and low-volume
    nodes of the profile smoothed over five levels; volumes that agree in DIGITS digits are equal. Sessions need five levels and volume."""
    keys = ("symbol", "session")
    w, whole = Window.partitionBy(*keys).orderBy("level"), Window.partitionBy(*keys)
    heavy = Window.partitionBy(*keys).orderBy(F.desc("vol"), "level")
    x = profile.withColumn("total", F.sum("vol").over(whole)).withColumn("n", F.count("*").over(whole)).filter("n >= 5 and total > 0")
    x = x.withColumn("before", F.coalesce(F.sum("vol").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("poc", F.first("level").over(heavy.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = x.withColumn("smooth", F.round(F.avg("vol").over(w.rowsBetween(-2, 2)), DIGITS))
    a, b, s = F.lag("smooth").over(w), F.lead("smooth").over(w), F.col("smooth")
    x = x.withColumn("peak", (s > a) & (s >= b)).withColumn("trough", (s < a) & (s <= b)).withColumn("away", F.abs(F.col("level") - F.col("poc")))
    area = F.when(F.round(F.col("before"), 6) < F.round(share * F.col("total"), 6), F.col("level"))
    near = lambda c: F.min_by(F.when(c, F.col("level")), F.when(c, F.struct("away", "level")))
    g = x.groupBy(*keys).agg(F.max("poc").alias("poc"), F.max(area).alias("vah"), F.min(area).alias("val"), near(F.col("peak") & (F.col("away") > 2)).alias("hvn"), near(F.col("trough")).alias("lvn"))
    return g.select(*keys, *((F.col(c) * tick).alias(c) for c in ("poc", "vah", "val", "hvn", "lvn")))


def contiguous_area(profile: DataFrame, tick: float, keys: tuple[str, ...], share: float = 0.7) -> DataFrame:
    """Point of control and the range grown from it, always by the heavier of the next traded levels above and below (above
    if equal), until it holds the share of volume.

    Growing by the heavier head of two lists takes levels in the order of the least volume up to them, so the order, and with
    it the running volume, comes from windows."""
    whole = Window.partitionBy(*keys)
    heavy = Window.partitionBy(*keys).orderBy(F.desc("vol"), "level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = profile.withColumn("total", F.sum("vol").over(whole)).withColumn("levels", F.count("*").over(whole)).withColumn("poc", F.first("level").over(heavy))
    side = F.signum(F.col("level") - F.col("poc"))
    x = x.withColumn("side", side).withColumn("away", F.abs(F.col("level") - F.col("poc")))
    x = x.withColumn("least", F.min("vol").over(Window.partitionBy(*keys, "side").orderBy("away").rowsBetween(Window.unboundedPreceding, 0)))
    taken = Window.partitionBy(*keys).orderBy((F.col("side") != 0), F.desc("least"), F.desc("side"), "away").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum("vol").over(taken), F.lit(0.0)))
    area = F.when(F.col("before") < share * F.col("total"), F.col("level"))
    return x.groupBy(*keys).agg((F.max("poc") * tick).alias("poc"), (F.max(area) * tick).alias("vah"), (F.min(area) * tick).alias("val"), F.max("total").alias("total_volume"), F.max("levels").alias("levels"))


def normal(*parts: Column) -> Column:
    """A standard normal number from the md5 of what is given (Box-Muller), the same in any engine."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    unit = lambda a: (F.conv(F.substring(digest, a, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(13))


def session_levels(bars: DataFrame, tick: float, least_bars: int = 8, or_minutes: int = 30, seed: int = 0) -> DataFrame:
    """(symbol, i, level, value) of all levels at every bar, each known by then: the last usable profile of a session before,
    the session's VWAP and its deviations, opening range, confirmed swings, and a random line as control."""
    x = sessions.session_vwap(bars).withColumn("vwap_u1", F.col("vwap") + F.col("vwap_sd")).withColumn("vwap_d1", F.col("vwap") - F.col("vwap_sd"))
    s = Window.partitionBy("symbol", "session")
    inside = F.col("minutes").between(sessions.RTH[0], sessions.RTH[0] + or_minutes - 1)
    after = F.col("minutes") >= sessions.RTH[0] + or_minutes
    x = x.withColumn("or_hi", F.when(after, F.max(F.when(inside, F.col("high"))).over(s))).withColumn("or_lo", F.when(after, F.min(F.when(inside, F.col("low"))).over(s)))
    x = sessions.swing_levels(x).withColumnRenamed("swing_high", "swing_hi").withColumnRenamed("swing_low", "swing_lo")
    days = x.groupBy("symbol", "session").agg(F.max_by("close", "i").alias("last"), (F.max("high") - F.min("low")).alias("range"))
    profile = profile_levels(bar_profile(bars, tick, least_bars), tick).select("symbol", "session", F.struct("poc", "vah", "val", "hvn", "lvn").alias("profile"))
    d = Window.partitionBy("symbol").orderBy("session")
    days = days.join(profile, ["symbol", "session"], "left").withColumn("p", F.last("profile", ignorenulls=True).over(d.rowsBetween(Window.unboundedPreceding, -1))).withColumn("pc", F.lag("last").over(d)).withColumn("pr", F.lag("range").over(d))
    days = days.withColumn("rand", F.when(F.col("pr") > 0, F.col("pc") + 0.5 * normal(F.lit(seed), F.col("symbol"), F.col("session")) * F.col("pr")))
    x = x.join(days.select("symbol", "session", "rand", *(F.col(f"p.{a}").alias(b) for a, b in zip(("poc", "vah", "val", "hvn", "lvn"), LEVELS))), ["symbol", "session"])
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in LEVELS)))
    return x.select(*bars.columns, "session", "minutes", "in_rth", one.alias("l")).select(*bars.columns, "session", "minutes", "in_rth", "l.*")


def breaks(levels: DataFrame, window: int) -> DataFrame:
    """Closes that cross a level, seen `window` bars later: direction, and the share of those bars, and of their volume, that
    held beyond it. One row for each break, at the bar where that is known."""
    w = Window.partitionBy("symbol", "level").orderBy("i")
    held = w.rowsBetween(-(window - 1), 0)
    x = levels.withColumn("above", truth(F.col("close") > F.col("value"))).withColumn("known", F.col("value").isNotNull())
    x = x.withColumn("broke", F.col("known") & F.coalesce(F.lag("known").over(w), F.lit(False)) & (F.col("above") != F.coalesce(F.lag("above").over(w), F.lit(False))))
    share = lambda v: full(v, "i", window, held)
    above = F.col("above").cast("double")
    time, vol = share(F.avg(above).over(held)), share(F.try_divide(F.sum(F.col("volume") * above).over(held), F.sum("volume").over(held)))
    x = x.withColumn("entry", F.lag("broke", window).over(w)).withColumn("up", F.lag("above", window).over(w)).withColumn("t", time).withColumn("v", vol)
    side = lambda c: F.when(F.col("up"), F.col(c)).otherwise(1 - F.col(c))
    return x.filter("entry").select("symbol", "level", "i", F.when(F.col("up"), 1).otherwise(-1).alias("direction"), side("t").alias("acc_time"), side("v").alias("acc_vol"))


def range_outcomes(bars: DataFrame, horizon: int) -> DataFrame:
    """(symbol, i, up_move, up_high, up_low): the move, the rise and the fall over the next bars as shares of their range, seen from above."""
    w = series().rowsBetween(1, horizon)
    high, low = full(F.max("high").over(w), "high", horizon, w), full(F.min("low").over(w), "low", horizon, w)
    span = F.when(high > low, high - low)
    return bars.select("symbol", "i", ((F.lead("close", horizon).over(series()) - F.col("close")) / span).alias("up_move"), ((high - F.col("close")) / span).alias("up_high"), ((F.col("close") - low) / span).alias("up_low"))


def directed(outcomes: DataFrame) -> DataFrame:
    """ret, mfe and mae (negative) in the direction of each row."""
    up = F.col("direction") > 0
    return outcomes.withColumn("ret", F.col("up_move") * F.col("direction")).withColumn("mfe", F.when(up, F.col("up_high")).otherwise(F.col("up_low"))).withColumn("mae", -F.when(up, F.col("up_low")).otherwise(F.col("up_high")))


def terciles(rows: DataFrame, value: str, keys: list[str], calibration: Column, least: int) -> DataFrame:
    """Adds side: 1 in the top third of the calibration rows' values, -1 in the bottom third (both if they coincide count as
    top), null between; rows whose pool has fewer than `least` values are left out. Limits are one row for each key."""
    pool = rows.filter(calibration & F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, [1 / 3, 2 / 3]).alias("q"), F.count("*").alias("pool")).filter(F.col("pool") >= least)
    x = rows.filter(F.col(value).isNotNull()).join(pool, keys)
    return x.withColumn("side", F.when(F.col(value) >= F.col("q")[1], 1).when(F.col(value) <= F.col("q")[0], -1)).drop("q", "pool")


def calibration(frac: float = 0.2) -> Column:
    """The first fifth of a symbol's bars."""
    return F.col("i") < F.floor(F.count("*").over(Window.partitionBy("symbol")) * frac)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""Sessions, anchored VWAP bands, touches and first-passage races."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import series, truth

ZONE = "America/Chicago"
RTH = (8 * 60 + 30, 15 * 60)


def local(ts: str = "ts", zone: str = ZONE) -> Column:
    """Local wall time of epoch seconds, without a zone."""
    return F.from_utc_timestamp(F.expr(f"timestampadd(SECOND, {ts}, timestamp_ntz'1970-01-01 00:00:00')"), zone)


def with_sessions(bars: DataFrame, rth: tuple[int, int] = RTH) -> DataFrame:
    """Adds local minutes, whether the bar starts in regular hours [from, to), and the session's day: local time + 7 hours."""
    x = bars.withColumn("minutes", (F.hour(local()) * 60 + F.minute(local())).cast("long"))
    return x.withColumn("in_rth", (F.col("minutes") >= rth[0]) & (F.col("minutes") < rth[1])).withColumn("session", F.date_format(local() + F.expr("interval 7 hours"), "yyyy-MM-dd"))


def in_clock_bucket(minutes: Column, start: int, stop: int) -> Column:
    """Half-open range of minutes that may wrap past midnight."""
    return (minutes >= start) & (minutes < stop) if start <= stop else (minutes >= start) | (minutes < stop)


def session_groups(bars: DataFrame) -> DataFrame:
    """Groups to permute within: number of the session, doubled, plus one in regular hours."""
    x = with_sessions(bars)
    fresh = (~F.col("session").eqNullSafe(F.lag("session").over(series()))).cast("long")
    return x.withColumn("group", 2 * F.sum(fresh).over(series()) + F.col("in_rth").cast("long"))


def session_vwap(bars: DataFrame) -> DataFrame:
    """VWAP of the typical price from the session's start, the bar included, with its standard deviation."""
    w = Window.partitionBy("symbol", "session").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum("volume").over(w)
    mean = F.try_divide(F.sum(tp * F.col("volume")).over(w), v)
    square = F.try_divide(F.sum(tp * tp * F.col("volume")).over(w), v)
    x = with_sessions(bars).withColumn("vwap", mean)
    return x.withColumn("vwap_sd", F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))


def causal_bands(bars: DataFrame, least_age: int = 5) -> DataFrame:
    """Anchored mean and deviation from the bars before this one in its session, void for the first bars and where flat.

    Sums are taken of differences to the session's first price, which keeps them small."""
    x = with_sessions(bars).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    s = Window.partitionBy("symbol", "session").orderBy("i")
    before = s.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("anchor", F.min_by("tp", "i").over(Window.partitionBy("symbol", "session"))).withColumn("age", F.row_number().over(s).cast("long") - 1)
    y = F.col("tp") - F.col("anchor")
    x = x.withColumn("m1", F.try_divide(F.sum(y * F.col("volume")).over(before), F.sum("volume").over(before))).withColumn("m2", F.try_divide(F.sum(y * y * F.col("volume")).over(before), F.sum("volume").over(before)))
    var = F.col("m2") - F.col("m1") * F.col("m1")
    ok = (F.col("age") >= least_age) & (var > 1e-9)
    x = x.withColumn("mu", F.when(ok, F.col("anchor") + F.col("m1"))).withColumn("sigma", F.when(ok, F.sqrt(var)))
    zone = F.coalesce(F.try_divide(F.col("close") - F.col("mu"), F.col("sigma")), F.lit(0.0)).cast("int")
    return x.withColumn("zone", zone).drop("tp", "anchor", "m1", "m2")


def first_touches(banded: DataFrame, k: int, sign: int) -> DataFrame:
    """First bar of each session that reaches the band k deviations above (+1) or below (-1)."""
    band = F.col("mu") + sign * k * F.col("sigma")
    hit = truth(F.col("high") >= band if sign > 0 else F.col("low") <= band)
    rank = F.row_number().over(Window.partitionBy("symbol", "session").orderBy("i"))
    return banded.filter(hit).withColumn("rank", rank).filter("rank = 1").drop("rank")


def race(banded: DataFrame, events: DataFrame, k: int, sign: int, horizon: int) -> DataFrame:
    """Per symbol, what comes first within the horizon after an event, with levels frozen at it.

    A: the mean against one band further out; B: from the mean on, the mirror band against the band further out;
    C: the mirror band against the band further out, from the event on. Ties are losses. Events whose horizon goes beyond
    the series are dropped before anything is counted."""
    last = banded.groupBy("symbol").agg(F.max("i").alias("last"))
    e = events.join(last, "symbol").filter(F.col("i") + horizon <= F.col("last")).select("symbol", F.col("i").alias("ev"), F.col("mu").alias("target"), (F.col("mu") + sign * (k + 1) * F.col("sigma")).alias("ext"), (F.col("mu") - sign * k * F.col("sigma")).alias("opp"))
    ahead = e.withColumn("i", F.explode(F.sequence(F.col("ev") + 1, F.col("ev") + horizon))).join(banded.select("symbol", "i", "high", "low"), ["symbol", "i"])
    up = sign < 0
    toward = lambda level: F.col("high") >= F.col(level) if up else F.col("low") <= F.col(level)
    adverse = F.col("low") <= F.col("ext") if up else F.col("high") >= F.col("ext")
    first = ahead.groupBy("symbol", "ev").agg(F.min(F.when(toward("target"), F.col("i"))).alias("t"), F.min(F.when(adverse, F.col("i"))).alias("x"), F.min(F.when(toward("opp"), F.col("i"))).alias("o"), F.collect_list(F.when(toward("opp"), F.col("i"))).alias("os"), F.collect_list(F.when(adverse, F.col("i"))).alias("xs"))
    never = F.lit(1 << 60)
    t, x, o = (F.coalesce(c, never) for c in ("t", "x", "o"))
    o2, x2 = (F.coalesce(F.array_min(F.filter(c, lambda v: v > F.col("t"))), never) for c in ("os", "xs"))
    a = first.select("symbol", ((t < x)).alias("aw"), (F.col("x").isNotNull() & (x <= t)).alias("al"), (F.col("t").isNotNull() & (t == x)).alias("tie"), (o2 < x2).alias("bw"), ((x2 < never) & (x2 <= o2)).alias("bl"), (o < x).alias("cw"), (F.col("x").isNotNull() & (x <= o)).alias("cl"))
    n = lambda c: F.sum(c.cast("long"))
    g = a.groupBy("symbol").agg(F.count("*").alias("n"), n(F.col("aw")).alias("aw"), n(F.col("aw") | F.col("al")).alias("nA"), n(F.col("aw") & F.col("bw")).alias("bw"), n(F.col("aw") & (F.col("bw") | F.col("bl"))).alias("nB"), n(F.col("cw")).alias("cw"), n(F.col("cw") | F.col("cl")).alias("nC"), n(F.col("tie")).alias("ties"))
    return g.select("symbol", "n", "nA", F.try_divide("aw", "nA").alias("pA"), "nB", F.try_divide("bw", "nB").alias("pB"), "nC", F.try_divide("cw", "nC").alias("pC"), (1 - F.col("nA") / F.col("n")).alias("unresolved"), (F.col("ties") / F.col("n")).alias("ambiguous"))


def opening_range(bars: DataFrame, minutes: int = 120) -> DataFrame:
    """High and low of the first minutes of regular hours, known only after them."""
    x = with_sessions(bars)
    inside = F.col("in_rth") & (F.col("minutes") < RTH[0] + minutes)
    after = F.col("in_rth") & (F.col("minutes") >= RTH[0] + minutes)
    s = Window.partitionBy("symbol", "session")
    return x.withColumn("or_high", F.when(after, F.max(F.when(inside, F.col("high"))).over(s))).withColumn("or_low", F.when(after, F.min(F.when(inside, F.col("low"))).over(s)))


def swing_levels(bars: DataFrame, k: int = 5) -> DataFrame:
    """Last confirmed swing high and low: the extreme of k bars either side, published k bars later and carried on."""
    around, carry = series().rowsBetween(-k, k), series().rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count("*").over(around) == 2 * k + 1
    x = bars.withColumn("ph", F.when(whole & (F.max("high").over(around) == F.col("high")), F.col("high"))).withColumn("pl", F.when(whole & (F.min("low").over(around) == F.col("low")), F.col("low")))
    x = x.withColumn("ph", F.lag("ph", k).over(series())).withColumn("pl", F.lag("pl", k).over(series()))
    return x.withColumn("swing_high", F.last("ph", ignorenulls=True).over(carry)).withColumn("swing_low", F.last("pl", ignorenulls=True).over(carry)).drop("ph", "pl")


def volume_profile(ticks: DataFrame, tick: float) -> DataFrame:
    """Volume by price level and day of the trades."""
    day = F.floor(F.col("ts") / 86400)
    return ticks.filter("type = 2").groupBy("symbol", day.alias("day"), F.expr(f"cast(bround(price / {tick}) as bigint)").alias("level")).agg(F.sum("size").alias("vol"))


def profile_summary(profile: DataFrame, tick: float, share: float = 0.7) -> DataFrame:
    """Point of control (lowest of equal ones) and the value area of the heaviest levels that hold the share of volume."""
    keys = ("symbol", "day")
    order = Window.partitionBy(*keys).orderBy(F.desc("vol"), "level")
    total = F.sum("vol").over(Window.partitionBy(*keys))
    before = F.coalesce(F.sum("vol").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = profile.withColumn("total", total).withColumn("inside", before < share * total)
    area = F.when(F.col("inside"), F.col("level"))
    return x.groupBy(*keys).agg((F.max_by("level", F.struct(F.col("vol"), -F.col("level"))) * tick).alias("poc"), (F.max(area) * tick).alias("vah"), (F.min(area) * tick).alias("val"), F.max("total").alias("total_volume"), F.count("*").alias("levels"))

"""Data quality of bars, and quote and trade microstructure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import series, lag, truth


def bar_checks(bars: DataFrame, step: int | None = None) -> DataFrame:
    """(symbol, name, n, verdict) of each check: nulls, OHLC sanity, duplicates, spacing, zero volume."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    tol = 1e-9
    bad = (h < F.greatest(o, c) - tol) | (lo > F.least(o, c) + tol) | (h < lo - tol)
    x = bars.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")))
    usual = x.groupBy("symbol", "gap").count().filter("gap is not null").groupBy("symbol").agg(F.max_by("gap", F.struct("count", -F.col("gap"))).alias("usual"))
    x = x.join(usual, "symbol", "left") if step is None else x.withColumn("usual", F.lit(step))
    n = lambda cond: F.sum(truth(cond).cast("long"))
    g = x.groupBy("symbol").agg(F.count("*").alias("bars"), n(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in ("open", "high", "low", "close", "volume")])).alias("nulls"), n(bad).alias("insane"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"), n(F.col("gap") != F.col("usual")).alias("odd_gaps"), n(F.col("volume") <= 0).alias("zero_volume"))
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("n"), v.alias("verdict")) for k, v in (
        ("nulls", F.when(F.col("nulls") > 0, "fail").otherwise("pass")), ("insane", F.when(F.col("insane") > 0, "fail").otherwise("pass")), ("duplicates", F.when(F.col("duplicates") > 0, "fail").otherwise("pass")),
        ("odd_gaps", F.when(F.col("odd_gaps") > 0, "warn").otherwise("pass")), ("zero_volume", F.when(F.col("zero_volume") > 0.02 * F.col("bars"), "warn").otherwise("pass")),
    )))
    return g.select("symbol", F.explode(rows).alias("c")).select("symbol", "c.*")


def cross_timeframe(fine: DataFrame, coarse: DataFrame, seconds: int) -> DataFrame:
    """Per symbol, coarse bars that disagree with the fine bars in their interval, and those without any."""
    agg = fine.withColumn("ts", F.floor(F.col("ts") / seconds) * seconds).groupBy("symbol", "ts").agg(F.min_by("open", "i").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "i").alias("c"))
    x = coarse.join(agg, ["symbol", "ts"], "left")
    off = (F.abs(F.col("open") - F.col("o")) > 1e-9) | (F.abs(F.col("high") - F.col("h")) > 1e-9) | (F.abs(F.col("low") - F.col("l")) > 1e-9) | (F.abs(F.col("close") - F.col("c")) > 1e-9)
    return x.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum(F.col("o").isNull().cast("long")).alias("empty"), F.sum(truth(off).cast("long")).alias("different"))


def jumps(with_atr: DataFrame, close_limit: float = 10.0, open_limit: float = 6.0) -> DataFrame:
    """Bars whose close moved, or whose open gapped, by too many ATRs."""
    x = with_atr.withColumn("jump", F.try_divide(F.abs(F.col("close") - lag("close")), "atr")).withColumn("splice", F.try_divide(F.abs(F.col("open") - lag("close")), "atr"))
    return x.filter((F.col("jump") > close_limit) | (F.col("splice") > open_limit)).select("symbol", "i", "jump", "splice")


def coverage(bars: DataFrame) -> DataFrame:
    """Days with bars, weekdays between the first and the last, largest gap in days."""
    d = bars.select("symbol", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")).alias("day")).distinct()
    g = d.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("symbol").orderBy("day")))).groupBy("symbol").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), F.max("gap").cast("long").alias("largest_gap"))
    weekdays = F.size(F.filter(F.sequence("first", "last"), lambda x: F.weekday(x) < 5))
    return g.select("symbol", "days", weekdays.cast("long").alias("weekdays"), "largest_gap")


QUOTE = {"bid": (0, "price"), "ask": (1, "price"), "bid_size": (0, "size"), "ask_size": (1, "size")}


def quotes(ticks: DataFrame) -> DataFrame:
    """Each tick with the last bid and ask known at it, and those known at the tick before (prev_...).

    Ticks are filled forward within a day; what a day starts with comes from the days before, one row for each symbol and
    day, so that no task holds more than one day of one symbol."""
    x = ticks.withColumn("day", F.floor(F.col("ts") / 86400))
    known = {c: F.when(F.col("type") == kind, F.col(v)) for c, (kind, v) in QUOTE.items()}
    ends = x.groupBy("symbol", "day").agg(*(F.max_by(v, F.when(v.isNotNull(), F.struct("ts", "seq"))).alias(c) for c, v in known.items()))
    d = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("symbol", "day", *(F.last(c, ignorenulls=True).over(d).alias(f"start_{c}") for c in QUOTE))
    w = Window.partitionBy("symbol", "day").orderBy("ts", "seq")
    y = x.join(starts, ["symbol", "day"])
    for rows, name in ((w.rowsBetween(Window.unboundedPreceding, 0), ""), (w.rowsBetween(Window.unboundedPreceding, -1), "prev_")):
        for c, v in known.items():
            y = y.withColumn(name + c, F.coalesce(F.last(v, ignorenulls=True).over(rows), F.col(f"start_{c}")))
    return y.drop("day", *(f"start_{c}" for c in QUOTE))


def spread_summary(quoted: DataFrame) -> DataFrame:
    """Quoted spreads that are sane: count, mean, quantiles."""
    s = quoted.withColumn("spread", F.col("ask") - F.col("bid")).filter("spread > 0 and spread < 50")
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.percentile("spread", 0.5).alias("median"), F.percentile("spread", 0.9).alias("p90"), F.percentile("spread", 0.99).alias("p99"))


def order_flow(quoted: DataFrame, seconds: int = 3600) -> DataFrame:
    """Order-flow imbalance of quote updates and signed trade volume, by interval."""
    b, a, bs, as_ = (F.col(x) for x in ("bid", "ask", "bid_size", "ask_size"))
    pb, pa, pbs, pas = (F.col(f"prev_{x}") for x in ("bid", "ask", "bid_size", "ask_size"))
    on = lambda cond, v: F.when(cond, v).otherwise(0.0)
    flow = on(b >= pb, bs) - on(b <= pb, pbs) - on(a <= pa, as_) + on(a >= pa, pas)
    near = lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y)
    sign = F.when(F.col("type") != 2, 0).when(truth(near(F.col("price"), a)), 1).when(truth(near(F.col("price"), b)), -1).otherwise(0)
    x = quoted.withColumn("ofi", F.when(F.col("type") < 2, F.when(pb.isNotNull() & pa.isNotNull(), flow))).withColumn("sign", sign)
    return x.groupBy("symbol", (F.floor(F.col("ts") / seconds) * seconds).alias("ts")).agg(F.sum("ofi").alias("ofi"), F.sum(F.col("sign") * F.col("size")).alias("signed_volume"), F.sum(F.when(F.col("type") == 2, F.col("size")).otherwise(0.0)).alias("volume"), F.avg(F.col("ask") - F.col("bid")).alias("mean_spread"), F.count("*").alias("updates"))


def merge_flow(flow: DataFrame) -> DataFrame:
    """Order-flow bars of several files with the same stamp become one: flows and volumes add up, the mean spread is the mean of means."""
    return flow.groupBy("symbol", "ts").agg(*(F.sum(c).alias(c) for c in ("ofi", "signed_volume", "volume")), F.avg("mean_spread").alias("mean_spread"), F.sum("updates").alias("updates"), F.count("*").alias("parts"))


def bias_battery(trades: DataFrame, bars: DataFrame, surface: DataFrame, keys: list[str], order: list[str], regime: str) -> DataFrame:
    """(check, verdict) of the bias checks that a strategy's trades, bars and parameter surface (x, y, v) can fail."""
    from . import trading

    worst = F.when(F.count(F.when(F.col("verdict") == "fail", 1)) > 0, "fail").when(F.count(F.when(F.col("verdict") == "warn", 1)) > 0, "warn").otherwise("pass").alias("verdict")
    named = lambda df, name: df.agg(worst).select(F.lit(name).alias("check"), "verdict")
    luck = trading.luck(trades, keys, order)
    runs = trading.runs_test(trades, keys, order).withColumn("verdict", F.when(F.abs("z") > 3, "warn").otherwise("pass"))
    near = trading.plateau(surface, "x", "y", "v").withColumn("verdict", F.when((F.col("v") > 0) & (F.col("near_mean") <= 0), "warn").otherwise("pass"))
    gaps = coverage(bars).withColumn("verdict", F.when(F.col("largest_gap") > 7, "warn").otherwise("pass"))
    return reduce(DataFrame.unionByName, [named(luck, "luck"), named(runs, "runs"), named(near, "plateau"), named(trading.regime_balance(trades, regime), "regimes"), named(gaps, "coverage")])


def order_checks(ticks: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows, stamps that occur again, and stamps that go backwards in the order of the file, by symbol. Rows are put in order within
    ranges of the file's numbers; between ranges only their ends meet."""
    x = ticks.withColumn("part", F.floor(F.col(seq) / 1_000_000))
    w = Window.partitionBy("symbol", "part").orderBy(seq)
    back = x.withColumn("back", truth(F.col("ts") < F.lag("ts").over(w)).cast("long"))
    p = back.groupBy("symbol", "part").agg(F.count("*").alias("n"), F.sum("back").alias("back"), F.min_by("ts", seq).alias("first"), F.max_by("ts", seq).alias("last"))
    p = p.withColumn("edge", truth(F.col("first") < F.lag("last").over(Window.partitionBy("symbol").orderBy("part"))).cast("long"))
    stamps = ticks.groupBy("symbol", "ts").agg(F.count("*").alias("k")).groupBy("symbol").agg(F.sum(F.col("k") - 1).alias("duplicates"))
    return p.groupBy("symbol").agg(F.sum("n").alias("n"), (F.sum("back") + F.sum("edge")).alias("backwards")).join(stamps, "symbol").select("symbol", "n", "duplicates", "backwards")


def check_bundle(bars: DataFrame, with_atr: DataFrame, fine: DataFrame | None = None, seconds: int | None = None) -> DataFrame:
    """(symbol, name, n, verdict) of all checks of one file's bars: the battery, jumps and splices, and, with finer bars, agreement with them."""
    found = jumps(with_atr).groupBy("symbol").agg(F.count(F.when(F.col("jump") > 10, 1)).alias("jumps"), F.count(F.when(F.col("splice") > 6, 1)).alias("splices"))
    rows = bars.select("symbol").distinct().join(found, "symbol", "left").select("symbol", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("jumps", "splices"))).unpivot("symbol", ["jumps", "splices"], "name", "n")
    out = bar_checks(bars).unionByName(rows.withColumn("verdict", F.when(F.col("n") > 0, "warn").otherwise("pass")))
    if fine is not None:
        c = cross_timeframe(fine, bars, seconds).unpivot("symbol", ["empty", "different"], "name", "n")
        out = out.unionByName(c.withColumn("verdict", F.when(F.col("n") > 0, "fail").otherwise("pass")))
    return out

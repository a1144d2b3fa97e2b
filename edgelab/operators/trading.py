"""Trade simulation, marking to market, trade statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import TRADES, simulate_series
from .windows import series

PRESETS = {"A": (None, None, True), "B": (2.0, None, True), "C": (2.0, 3.0, False), "D": (1.5, 4.5, False)}
def simulate(features: DataFrame, presets: dict | None = None, cost: float = 0.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades of each series and preset. features: symbol, i, open..close, atr, long, short, in_window, trend_up."""
    chosen = presets or PRESETS
    return features.groupBy(*keys).applyInPandas(lambda p: simulate_series(p, chosen, cost), TRADES)


def bar_pnl(trades: DataFrame, bars: DataFrame, cost: float = 0.0) -> DataFrame:
    """P&L of each bar of each trade: closes mark it from the bar after the entry on; the exit bar uses the fill and bears the cost."""
    held = trades.withColumn("i", F.explode(F.sequence(F.col("entry_i") + 1, F.greatest(F.col("exit_i"), F.col("entry_i") + 1)))).filter("i <= exit_i")
    marked = bars.select("symbol", "i", "close", F.lag("close").over(series()).alias("before"))
    last = F.col("i") == F.col("exit_i")
    return held.join(marked, ["symbol", "i"]).select("symbol", "cfg", "entry_i", "i", ((F.when(last, F.col("exit_px")).otherwise(F.col("close")) - F.col("before")) * F.col("direction") - F.when(last, F.lit(cost)).otherwise(0.0)).alias("pnl"))


def trade_stats(trades: DataFrame, keys: list[str], pnl: str = "pnl", r: str = "pnl_r") -> DataFrame:
    """Count, mean and median R (clipped to 15), profit factor on R, share of winners on unclipped points."""
    clipped = F.greatest(F.least(F.col(r), F.lit(15.0)), F.lit(-15.0))
    return trades.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(clipped).alias("mean_r"), F.percentile(clipped, 0.5).alias("median_r"), F.try_divide(F.sum(F.when(clipped > 0, clipped)), -F.sum(F.when(clipped < 0, clipped))).alias("profit_factor"), F.avg((F.col(pnl) > 0).cast("int")).alias("win_rate"), F.sum(pnl).alias("total"))


def luck(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl", top: int = 5) -> DataFrame:
    """How much of the gross profit the best few trades are, and what is left without them. The best are cut to `top` in each
    task before they meet."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pnl), *order))
    best = trades.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy(*keys).agg(F.sum(pnl).alias("top"))
    g = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(pnl).alias("total"), F.sum(F.when(F.col(pnl) > 0, F.col(pnl))).alias("gross")).join(best, keys)
    rest = F.col("total") - F.col("top")
    share = F.try_divide("top", "gross")
    return g.select(*keys, "n", "total", rest.alias("without_top"), share.alias("top_share"), F.when((F.col("total") > 0) & (rest <= 0), "fail").when(share > 0.5, "warn").otherwise("pass").alias("verdict"))


def runs_test(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl") -> DataFrame:
    """Runs of equal signs against their expectation; zero results are left out. Signs are put in order within each value of
    the first column of the order; between those only their first and last signs meet."""
    block, at = order[0], F.struct(*order[1:])
    w = Window.partitionBy(*keys, block).orderBy(*order[1:])
    s = trades.filter(F.col(pnl) != 0).withColumn("sign", F.signum(pnl)).withColumn("at", at)
    s = s.withColumn("turn", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("long"), F.lit(0)))
    b = s.groupBy(*keys, block).agg(F.count("*").alias("n"), F.sum((F.col("sign") > 0).cast("long")).alias("p"), F.sum("turn").alias("turns"), F.min_by("sign", "at").alias("first"), F.max_by("sign", "at").alias("last"))
    b = b.withColumn("edge", F.coalesce((F.col("first") != F.lag("last").over(Window.partitionBy(*keys).orderBy(block))).cast("long"), F.lit(0)))
    g = b.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), (1 + F.sum("turns") + F.sum("edge")).alias("runs"))
    mu = F.try_divide(2.0 * F.col("p") * (F.col("n") - F.col("p")), "n") + 1
    var = F.try_divide((mu - 1) * (mu - 2), F.col("n") - 1)
    return g.select(*keys, "n", "runs", mu.alias("expected_runs"), F.when(var > 0, F.try_divide(F.col("runs") - mu, F.sqrt(var))).alias("z"))


def equity(pnl: DataFrame, keys: list[str], order: list[str], value: str = "pnl") -> DataFrame:
    """Running total, its maximum, drawdown, and rolling sum and win rate of 20."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = pnl.withColumn("equity", F.sum(value).over(run)).withColumn("peak", F.max("equity").over(run)).withColumn("drawdown", F.col("equity") - F.col("peak"))
    last = w.rowsBetween(-19, 0)
    whole = F.count("*").over(last) == 20
    return x.withColumn("roll_sum", F.when(whole, F.sum(value).over(last))).withColumn("roll_win", F.when(whole, F.avg((F.col(value) > 0).cast("int")).over(last)))


def plateau(surface: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Each cell of a parameter grid against its neighbours, one step along one axis: each cell is sent to its four places,
    where an equal join finds who is there. Ranks are those of the axes' distinct values."""
    ranked = lambda c, n: surface.select(c).distinct().withColumn(n, F.dense_rank().over(Window.orderBy(c)))
    s = surface.join(ranked(x, "rx"), x).join(ranked(y, "ry"), y)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    sent = s.select("rx", "ry", F.col(value).alias("near"), steps.alias("step")).select((F.col("rx") + F.col("step.a")).alias("rx"), (F.col("ry") + F.col("step.b")).alias("ry"), "near")
    return s.join(sent, ["rx", "ry"]).groupBy(x, y, value).agg(F.count("*").alias("neighbours"), F.avg("near").alias("near_mean"), F.min("near").alias("near_least"))


def regime_balance(trades: DataFrame, regime: str, pnl: str = "pnl") -> DataFrame:
    """Trades and result of each regime, its share of the gross of profitable regimes, and whether one regime dominates."""
    g = trades.groupBy(regime).agg(F.count("*").alias("n"), F.sum(pnl).alias("total"))
    whole = Window.partitionBy(F.lit(1))  # one row for each regime
    share = F.try_divide(F.greatest("total", F.lit(0.0)), F.sum(F.greatest("total", F.lit(0.0))).over(whole))
    return g.withColumn("share", share).withColumn("verdict", F.when(F.max("share").over(whole) > 0.8, "warn").otherwise("pass"))


def split_summary(trades: DataFrame, keys: list[str], split: Column, pnl: str = "pnl", r: str = "pnl_r") -> DataFrame:
    """Trade statistics of the training and the test part."""
    return trade_stats(trades.withColumn("part", F.when(split, "train").otherwise("test")), [*keys, "part"], pnl, r)


def month_table(trades: DataFrame, day: str, pnl: str = "pnl") -> DataFrame:
    """One row a year with a column for each month and the year's total."""
    months = list(range(1, 13))
    p = trades.select(F.year(day).alias("year"), F.month(day).alias("month"), pnl).groupBy("year").pivot("month", months).sum(pnl)
    named = p.select("year", *(F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(f"m{m:02d}") for m in months))
    return named.withColumn("total", sum((F.col(f"m{m:02d}") for m in months), F.lit(0.0)))


def usual_month(bars: DataFrame, month: str, least_share: float = 0.5) -> DataFrame:
    """Median bars a month by symbol, months with half of the fullest one's or less left out."""
    g = bars.groupBy("symbol", month).agg(F.count("*").alias("bars")).withColumn("most", F.max("bars").over(Window.partitionBy("symbol")))
    return g.filter(F.col("bars") > least_share * F.col("most")).groupBy("symbol").agg(F.count("*").alias("months"), F.percentile("bars", 0.5).alias("median_bars"))


def dependence(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl") -> DataFrame:
    """Mean of the next trade after a winner and after a loser; the order's first column parts the trades, and between its
    values only the first trade of the next one is looked at."""
    block, w = order[0], Window.partitionBy(*keys, order[0]).orderBy(*order[1:])
    first = trades.groupBy(*keys, block).agg(F.min_by(pnl, F.struct(*order[1:])).alias("first"))
    after = first.select(*keys, block, F.lead("first").over(Window.partitionBy(*keys).orderBy(block)).alias("after_block"))
    x = trades.withColumn("next", F.lead(pnl).over(w)).join(after, [*keys, block]).withColumn("next", F.coalesce("next", "after_block")).filter("next is not null")
    return x.groupBy(*keys).agg(F.avg(F.when(F.col(pnl) > 0, F.col("next"))).alias("after_win"), F.avg(F.when(F.col(pnl) < 0, F.col("next"))).alias("after_loss"), F.count("*").alias("pairs"))

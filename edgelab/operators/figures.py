"""The numbers behind figures, as small tables; drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, low, high, n): equal bins between the least and the greatest value of each key; empty bins are left out."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    x = rows.join(ends, keys).withColumn("step", (F.col("most") - F.col("least")) / bins)
    at = F.when(F.col("step") > 0, F.least(F.floor((F.col(value) - F.col("least")) / F.col("step")), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    g = x.withColumn("bin", at).groupBy(*keys, "bin", "least", "step").agg(F.count("*").alias("n"))
    return g.select(*keys, "bin", (F.col("least") + F.col("bin") * F.col("step")).alias("low"), (F.col("least") + (F.col("bin") + 1) * F.col("step")).alias("high"), "n")


def fan(paths: DataFrame, keys: list[str], at: str, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(keys, at, real, p05, ...): the market's path (perm 0) among the draws' percentiles at every point."""
    g = paths.groupBy(*keys, at).agg(F.max(F.when(F.col("perm") == 0, F.col(value))).alias("real"), F.percentile(F.when(F.col("perm") > 0, F.col(value)), list(shares)).alias("p"))
    return g.select(*keys, at, "real", *(F.col("p")[k].alias(f"p{int(100 * s):02d}") for k, s in enumerate(shares)))


def excursions(trades: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Trades by adverse and favourable excursion in steps, winners and losers apart."""
    place = lambda c: (F.floor(F.col(c) / step) * step).alias(c)
    return trades.groupBy(*keys, (F.col("pnl") > 0).alias("won"), place("mae"), place("mfe")).agg(F.count("*").alias("n"))


def sharpe(pnl: DataFrame, keys: list[str], value: str = "pnl") -> DataFrame:
    """Mean over sample deviation of each configuration; null without spread."""
    return pnl.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.avg(value), F.when(F.stddev_samp(value) > 0, F.stddev_samp(value))).alias("sharpe"))


def underwater(equity: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Spells below the last peak: (keys, spell, start, stop, depth, points). equity has drawdown."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = equity.withColumn("below", F.col("drawdown") < 0)
    x = x.withColumn("fresh", (F.col("below") & ~F.coalesce(F.lag("below").over(w), F.lit(False))).cast("int")).withColumn("spell", F.sum("fresh").over(w))
    return x.filter("below").groupBy(*keys, "spell").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.min("drawdown").alias("depth"), F.count("*").alias("points"))

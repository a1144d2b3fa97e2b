"""Indicators over bars (symbol, i, open, high, low, close, volume). Each adds columns; missing values are null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .kernels import trend_line
from .windows import series, back, col, full, lag, roll, truth


def true_range() -> Column:
    """greatest() skips the missing previous close of the first bar."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def mid_donchian(n: int) -> Column:
    return (roll(F.max, "high", n) + roll(F.min, "low", n)) / 2


def wma(x: str, n: int) -> Column:
    """Weights 1..n, the newest heaviest."""
    return full(sum((F.coalesce(F.lag(col(x), k).over(series()), F.lit(0.0)) * (n - k) for k in range(n)), F.lit(0.0)) / (n * (n + 1) / 2), x, n)


def steps(x: str = "close") -> Column:
    return F.coalesce(col(x) - lag(x), F.lit(0.0))


def efficiency_ratio(n: int, signed: bool = False) -> Column:
    """Net move over the path of the last n steps; needs change and path columns to have been added by with_steps."""
    net = F.col("close") - lag("close", n)
    path = F.sum(F.abs(F.col("step"))).over(back(n))
    return F.when(net.isNotNull(), F.coalesce(F.try_divide(net if signed else F.abs(net), path), F.lit(0.0)))


def with_steps(df: DataFrame) -> DataFrame:
    return df.withColumn("step", steps()).withColumn("tr", true_range())


def choppiness(n: int) -> Column:
    span = roll(F.max, "high", n) - roll(F.min, "low", n)
    return F.when(span > 0, 100 * F.log10(roll(F.sum, "tr", n) / span) / float(np.log10(n)))


def cmo(n: int) -> Column:
    up, down = F.greatest(F.col("step"), F.lit(0.0)), F.greatest(-F.col("step"), F.lit(0.0))
    a, b = F.sum(up).over(back(n)), F.sum(down).over(back(n))
    return full(100 * F.try_divide(a - b, a + b), "step", n)


def confirm(condition: Column, bars: int) -> Column:
    return truth(F.min(truth(condition).cast("int")).over(back(bars)) == 1)


def window_menu(bars: DataFrame) -> DataFrame:
    """The indicators with finite frames."""
    x = with_steps(bars)
    x = x.withColumn("wma_half", wma("close", 4)).withColumn("wma_full", wma("close", 9)).withColumn("hull_raw", 2 * F.col("wma_half") - F.col("wma_full"))
    mean, sd = roll(F.avg, "close", 20), roll(F.stddev_samp, "close", 20)
    return x.select(
        *bars.columns, "tr", F.col("wma_full").alias("wma9"), wma("hull_raw", 3).alias("hma9"), mid_donchian(9).alias("mid9"), roll(F.max, "high", 20).alias("donchian_high"), roll(F.min, "low", 20).alias("donchian_low"),
        F.try_divide(full(F.sum(F.col("close") * F.col("volume")).over(back(12)), "close", 12), F.sum("volume").over(back(12))).alias("vwma12"), efficiency_ratio(10).alias("er10"), efficiency_ratio(10, True).alias("ser10"), choppiness(14).alias("chop14"),
        cmo(9).alias("cmo9"), (100 * F.try_divide(F.col("close") - lag("close", 10), lag("close", 10))).alias("roc10"), mean.alias("boll_mid"), (mean + 2 * sd).alias("boll_high"), (mean - 2 * sd).alias("boll_low"), lag(mid_donchian(9), 0).alias("mid9_now"), confirm(F.col("close") > F.col("open"), 3).alias("three_up"),
    ).withColumn("mid9_displaced", lag("mid9", 26)).drop("mid9_now")


def atr(df: DataFrame, n: int = 14, out: str = "atr", shifted: bool = True) -> DataFrame:
    """Smoothed true range; shifted by a bar so that a bar's own range is not in it."""
    x = scan.rma(df.withColumn("tr", true_range()), F.col("tr"), n, out)
    return x.withColumn(out, lag(out)) if shifted else x


MENU = ["ema9", "tema9", "atr14", "rsi14", "macd", "macd_signal", "kama10", "vidya12", "tsi", "keltner_high", "keltner_low"]


def scan_menu(bars: DataFrame) -> DataFrame:
    """The indicators that are recurrences: EMA, TEMA, ATR, RSI, MACD, KAMA, VIDYA, TSI, Keltner; those of equal depth share a block scan."""
    x = with_steps(bars)
    x = x.withColumn("sc", F.pow(F.coalesce(efficiency_ratio(10), F.lit(0.0)) * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2.0))).withColumn("vk", F.coalesce(F.abs(cmo(9)) / 100, F.lit(0.0)) * (2 / 13))
    x = x.select("symbol", "i", "close", "tr", "step", "sc", "vk")
    step = F.col("step")
    x = scan.scan_many(x, {
        "ema9": scan.span("close", 9), "atr14": scan.wilder("tr", 14), "gain": scan.wilder(F.greatest(step, F.lit(0.0)), 14), "loss": scan.wilder(F.greatest(-step, F.lit(0.0)), 14), "fast": scan.span("close", 12), "slow": scan.span("close", 26),
        "kama10": scan.smoothing("close", F.col("sc")), "vidya12": scan.smoothing("close", F.col("vk")), "m1": scan.wilder("step", 25), "a1": scan.wilder(F.abs(step), 25),
    })
    x = x.withColumn("macd", F.col("fast") - F.col("slow"))
    x = scan.scan_many(x, {"e2": scan.span("ema9", 9), "macd_signal": scan.span("macd", 9), "m2": scan.wilder("m1", 13), "a2": scan.wilder("a1", 13)})
    x = scan.scan_many(x, {"e3": scan.span("e2", 9)})
    rsi = F.when(F.col("loss") > 0, 100 - 100 / (1 + F.try_divide("gain", "loss"))).otherwise(F.lit(100.0))
    return x.select("symbol", "i", "ema9", (3 * (F.col("ema9") - F.col("e2")) + F.col("e3")).alias("tema9"), "atr14", rsi.alias("rsi14"), "macd", "macd_signal", "kama10", "vidya12", (100 * F.try_divide("m2", F.when(F.col("a2") > 0, F.col("a2")))).alias("tsi"), (F.col("slow") + 2 * F.col("atr14")).alias("keltner_high"), (F.col("slow") - 2 * F.col("atr14")).alias("keltner_low"))


def super_trend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    """Bands that only tighten while the trend holds: a state machine per series."""
    x = atr(bars, n, "atr", shifted=False)
    return x.groupBy("symbol").applyInPandas(lambda p: trend_line(p, mult), "symbol string, i long, super_trend double, super_trend_up boolean")

"""Path conditioners, their time-of-day baselines, direction calls, linear filters, and the economics of fading."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan, sessions
from .windows import back, full, lag, series

#: Weights of the composite (fixed values); what of it depends on the side.
WEIGHTS = {"disp": 0.30, "ser": 0.25, "speed": 0.20, "persist": 0.15, "relvol": 0.10}
SIGNED = ("disp", "ser", "speed")
CONDITIONERS = ("disp", "ser", "persist", "rot", "speed", "relvol", "composite")


def baseline(x: DataFrame, value: str, least: int, out: str, ratio: bool = False) -> DataFrame:
    """Adds `out`: the value against its own quarter of an hour, as a z-score or a ratio to the mean, from calibration rows
    (calib) alone; null where a slot has fewer than `least` of them. The baselines are 96 rows a symbol."""
    v = F.col(value)
    g = x.filter(F.col("calib") & v.isNotNull()).groupBy("symbol", "slot").agg(F.avg(v).alias("b_mean"), F.stddev_samp(v).alias("b_sd"), F.count("*").alias("b_n")).filter(F.col("b_n") >= least).drop("b_n")
    y = x.join(g, ["symbol", "slot"], "left")
    z = F.when(F.col("b_mean") > 0, v / F.col("b_mean")) if ratio else F.when(F.col("b_sd") > 0, (v - F.col("b_mean")) / F.col("b_sd"))
    return y.withColumn(out, z).drop("b_mean", "b_sd")


def z_score(x: DataFrame, value: str, least: int, out: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds `out`: the value's z-score by the calibration rows of its keys; null with fewer than `least` of them or without spread."""
    v = F.col(value)
    g = x.filter(F.col("calib") & v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("z_mean"), F.stddev_samp(v).alias("z_sd"), F.count("*").alias("z_n")).filter((F.col("z_n") >= least) & (F.col("z_sd") > 0)).drop("z_n")
    return x.join(g, list(keys), "left").withColumn(out, (v - F.col("z_mean")) / F.col("z_sd")).drop("z_mean", "z_sd")


def raw_conditioners(bars: DataFrame, n: int, bar_seconds: int, frac: float = 0.2, least: int = 30) -> DataFrame:
    """Adds calib and six measures of the last n bars' path: displacement in ATRs, signed efficiency, persistence, rotation,
    speed and relative volume against the time of day. bars have atr."""
    r = F.col("close") - lag("close")
    x = sessions.with_sessions(bars).withColumn("slot", F.floor(F.col("minutes") / 15)).withColumn("calib", F.col("i") < F.floor(F.count("*").over(Window.partitionBy("symbol")) * frac))
    x = x.withColumn("r", r).withColumn("net", F.col("close") - lag("close", n)).withColumn("sg", F.signum("r"))
    x = x.withColumn("flip", F.coalesce(F.col("sg") != lag("sg"), F.lit(False)).cast("int"))
    path = full(F.sum(F.abs("r")).over(back(n)), "r", n)
    x = x.withColumn("path", path).withColumn("disp", F.col("net") / F.when(F.col("atr") > 0, F.col("atr"))).withColumn("ser", F.when(F.col("path") > 0, F.col("net") / F.col("path")).otherwise(F.lit(0.0)))
    x = x.withColumn("persist", F.abs(full(F.sum("sg").over(back(n)), "sg", n)) / n).withColumn("rot", -full(F.sum("flip").over(back(n)), "flip", n) / max(n - 1, 1)).withColumn("raw_speed", F.col("net") / (n * bar_seconds))
    x = baseline(baseline(x, "raw_speed", least, "speed"), "volume", least, "relvol", ratio=True)
    return x.drop("r", "net", "sg", "flip", "path", "raw_speed", "slot")


def conditioned(raw: DataFrame, side: Column, least: int = 30) -> DataFrame:
    """(raw, d, cond, x): the seven conditioners seen from the side d (1 or -1; rows without one are left out), in long form."""
    x = raw.withColumn("d", side).withColumn("disp_d", F.col("disp") * F.col("d"))
    x = z_score(z_score(x, "disp_d", least, "z_disp"), "relvol", least, "z_relvol")
    d = F.col("d")
    mix = WEIGHTS["disp"] * F.col("z_disp") + WEIGHTS["ser"] * F.col("ser") * d + WEIGHTS["speed"] * F.col("speed") * d + WEIGHTS["persist"] * F.col("persist") + WEIGHTS["relvol"] * F.col("z_relvol")
    values = F.array(*(F.struct(F.lit(c).alias("cond"), (mix if c == "composite" else F.col(c) * d if c in SIGNED else F.col(c)).alias("x")) for c in CONDITIONERS))
    return x.filter(d.isNotNull()).withColumn("c", F.explode(values)).select("*", "c.*").drop("c", "disp_d", "z_disp", "z_relvol")


def outcome_ratios(rows: DataFrame, keys: list[str], outcomes: list[str]) -> DataFrame:
    """Mean outcomes of the top third over those of the bottom third; side is 1 or -1."""
    mean = lambda c, s: F.avg(F.when(F.col("side") == s, F.col(c)))
    g = rows.groupBy(*keys).agg(*(mean(c, s).alias(f"{c}_{n}") for c in outcomes for s, n in ((1, "hi"), (-1, "lo"))), F.count(F.when(F.col("side") == 1, 1)).alias("n_hi"), F.count(F.when(F.col("side") == -1, 1)).alias("n_lo"))
    return g.select(*keys, "n_hi", "n_lo", *(F.try_divide(f"{c}_hi", f"{c}_lo").alias(f"{c}_ratio") for c in outcomes))


def direction_calls(banded: DataFrame, n: int, ema_n: int = 20, slope: int = 5, z_window: int = 100) -> DataFrame:
    """(symbol, i, close, call_kind, call): six calls of the next move, 0 for no opinion. banded: one kind of anchored bands."""
    x = scan.scan_many(banded, {"e": scan.span("close", ema_n)})
    x = x.withColumn("pr", F.col("close") - lag("close", n)).withColumn("lr", F.col("close") - lag("close", 4 * n))
    mean, sd = full(F.avg("pr").over(back(z_window)), "pr", z_window), full(F.stddev_samp("pr").over(back(z_window)), "pr", z_window)
    x = x.withColumn("zz", F.try_divide(F.col("pr") - mean, sd)).withColumn("rise", F.col("e") - lag("e", slope))
    sign = lambda c: F.coalesce(F.signum(c), F.lit(0.0))
    short, long = sign(F.col("pr")), sign(F.col("lr"))
    calls = {
        "close_vs_ema": sign(F.col("close") - F.col("e")), "ema_slope": sign(F.col("rise")), "vwap_zone": F.signum(F.col("zone").cast("double")), "past_return": short,
        "past_return_z": F.when(F.abs("zz") >= 1, F.signum("zz")).otherwise(F.lit(0.0)), "two_scale": F.when((long != 0) & (short == -long), long).otherwise(F.lit(0.0)),
    }
    rows = x.select("symbol", "i", "close", F.explode(F.array(*(F.struct(F.lit(k).alias("call_kind"), c.alias("call")) for k, c in calls.items()))).alias("c"))
    return rows.select("symbol", "i", "close", "c.*")


def _solve(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Weights of one symbol from the sums of products of its k + 1 regressors and of each with the target."""
    a, b = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    for p, q, s in zip(pdf["p"], pdf["q"], pdf["s"]):
        if q > k:
            b[p] = s
        else:
            a[p, q] = s
    return pd.DataFrame([(pdf["symbol"].iloc[0], np.linalg.lstsq(a, b, rcond=None)[0].tolist())], columns=["symbol", "weights"])


def linear_ceiling(bars: DataFrame, k: int, n: int, scale: int = 200, least: int = 500) -> DataFrame:
    """Best in-sample accuracy of a linear rule on the last k scaled returns for the direction of the next n bars, over samples
    that do not overlap. Sums of products are aggregated; (k + 1)^2 numbers a symbol are solved."""
    r = F.coalesce(F.ln("close") - F.ln(lag("close")), F.lit(0.0))
    x = bars.withColumn("r", r)
    sd = full(F.stddev_samp("r").over(back(scale)), "r", scale)
    x = x.withColumn("rn", F.when(sd > 0, F.col("r") / sd).otherwise(F.lit(0.0)))
    start, last = max(k, scale), F.max("i").over(Window.partitionBy("symbol"))
    lags = F.array(*(F.lag("rn", j).over(series()) for j in range(k)), F.lit(1.0))
    x = x.withColumn("v", lags).withColumn("y", F.signum(F.lead("close", n).over(series()) - F.col("close"))).withColumn("last", last)
    x = x.filter((F.col("i") >= start) & ((F.col("i") - start) % n == 0) & (F.col("i") < F.col("last") + 1 - n) & (F.col("y") != 0)).select("symbol", "v", "y")
    products = x.select("symbol", F.posexplode("v").alias("p", "a"), "v", "y").select("symbol", "p", "a", F.posexplode(F.concat("v", F.array("y"))).alias("q", "b"))
    sums = products.groupBy("symbol", "p", "q").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    weights = sums.groupBy("symbol").applyInPandas(lambda p: _solve(p, k), "symbol string, weights array<double>")
    guess = F.signum(F.aggregate(F.zip_with("v", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a))
    g = x.join(weights, "symbol").withColumn("guess", guess).filter("guess <> 0").groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col("y")).cast("int")).alias("accuracy"))
    return g.select("symbol", "n", F.when(F.col("n") >= least, F.col("accuracy")).alias("accuracy"))


def fade_economics(ratios: DataFrame, spread: float, cost: float) -> DataFrame:
    """What the first autocorrelation is worth: from (symbol, n, vr, sigma) with VR(2), the part that bid-ask bounce explains,
    the gross of fading one step, and the net at the estimate and at the end of its confidence interval nearer to zero."""
    rho, edge = F.col("vr") - 1, math.sqrt(2 / math.pi)
    near = rho + 1.96 / F.sqrt("n")
    gross, low = F.abs(rho) * F.col("sigma") * edge, F.when(near < 0, F.abs(near) * F.col("sigma") * edge).otherwise(F.lit(0.0))
    return ratios.select("symbol", "n", rho.alias("rho"), (1 / F.sqrt("n")).alias("se"), (-F.lit(spread**2) / (4 * F.col("sigma") * F.col("sigma"))).alias("bounce"), gross.alias("gross"), (gross - cost).alias("net"), (low - cost).alias("net_low"))

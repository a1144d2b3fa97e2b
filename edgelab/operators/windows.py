"""Frames over bars, with the rule that a window counts only if it is full."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def series():
    """A symbol's bars in order. A function, as window specifications need a session."""
    return Window.partitionBy("symbol").orderBy("i")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def back(n: int, keys: tuple[str, ...] = ("symbol",)):
    return Window.partitionBy(*keys).orderBy("i").rowsBetween(-(n - 1), 0)


def ahead(h: int):
    return series().rowsBetween(1, h)


def full(value: Column, x: Column | str, n: int, frame=None) -> Column:
    """The value where the window holds n known x; null before that."""
    return F.when(F.count(col(x)).over(frame or back(n)) == n, value)


def roll(fn, x: Column | str, n: int) -> Column:
    return full(fn(col(x)).over(back(n)), x, n)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(col(x), n).over(series())


def truth(condition: Column) -> Column:
    """A comparison with a missing value is false, also before it is negated."""
    return F.coalesce(condition, F.lit(False))


def log(x: Column | str) -> Column:
    """Natural logarithm with minus infinity for 0 and NaN below it, as in SQL engines that follow IEEE; Spark's ln is null there,
    and sums would leave such rows out."""
    c = col(x)
    return F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(F.ln(c))


def finite(x: Column | str) -> Column:
    """The value, or null where it is infinite or NaN."""
    c = col(x)
    return F.when(F.abs(c) < float("inf"), c)

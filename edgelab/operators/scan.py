"""Affine recurrences y_t = a_t y_{t-1} + b_t as a distributed scan.

The recurrence is cut into blocks of BLOCK rows, each gathered into one row. A block's composition (A, B) says what it makes
of any value before it, y = A y_before + B; compositions, one row for each BLOCK bars, are folded in order, and each block
then unrolls from its own start. Any number of recurrences share the pass. Nothing is divided, so a may be 0 (a reset), 1 or
anything between. One long series is spread over all its blocks; only compositions of a series meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def _fold(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """What comes before each block: the compositions of all blocks before it, applied in order."""
    pdf = pdf.sort_values("scan_block")
    for k in range(n):
        carry, out = 0.0, []
        for a, own in zip(pdf[f"scan_a{k}"], pdf[f"scan_b{k}"]):
            out.append(carry)
            carry = a * carry + own
        pdf[f"scan_c{k}"] = out
    return pdf.drop(columns=[f"scan_{p}{k}" for p in "ab" for k in range(n)])


def scan_many(df: DataFrame, recurrences: dict[str, tuple[Column, Column]], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds one column for each recurrence {name: (a, b)}. df has the keys and a gapless i from 0; a and b are known on every row; row 0 yields b."""
    names, columns = list(recurrences), [c for c in df.columns if c != "i"]
    parts = [c for k, (a, b) in enumerate(recurrences.values()) for c in (F.when(F.col("i") == 0, F.lit(0.0)).otherwise(a).alias(f"scan_a{k}"), b.cast("double").alias(f"scan_b{k}"))]
    x = df.select("i", *columns, *parts)
    held = [f"scan_{p}{k}" for k in range(len(names)) for p in "ab"]
    blocks = x.groupBy(*keys, F.floor(F.col("i") / BLOCK).alias("scan_block")).agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in columns if c not in keys], *held))).alias("scan_rows"))

    def composed(k: int) -> Column:
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        return F.aggregate("scan_rows", start, lambda s, r: F.struct((s["a"] * r[f"scan_a{k}"]).alias("a"), (r[f"scan_a{k}"] * s["b"] + r[f"scan_b{k}"]).alias("b")))

    def unrolled(k: int) -> Column:
        start = F.struct(F.col(f"scan_c{k}").alias("y"), F.array().cast("array<double>").alias("all"))
        step = lambda s, r: (y := r[f"scan_a{k}"] * s["y"] + r[f"scan_b{k}"], F.struct(y.alias("y"), F.array_append(s["all"], y).alias("all")))[1]
        return F.aggregate("scan_rows", start, step, lambda s: s["all"])

    both = blocks.select(*keys, "scan_block", *(composed(k).alias(f"scan_s{k}") for k in range(len(names))))
    both = both.select(*keys, "scan_block", *(F.col(f"scan_s{k}.{p}").alias(f"scan_{p}{k}") for k in range(len(names)) for p in "ab"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["scan_block long"] + [f"scan_c{k} double" for k in range(len(names))])
    carry = both.groupBy(*keys).applyInPandas(lambda p: _fold(p, len(names)), schema)
    rows = blocks.join(carry, [*keys, "scan_block"]).select(*keys, "scan_rows", *(unrolled(k).alias(f"scan_y{k}") for k in range(len(names))))
    flat = rows.select(*keys, F.explode(F.arrays_zip("scan_rows", *(f"scan_y{k}" for k in range(len(names))))).alias("scan"))
    return flat.select(*(F.col(c) if c in keys else F.col(f"scan.scan_rows.{c}").alias(c) for c in df.columns), *(F.col(f"scan.scan_y{k}").alias(n) for k, n in enumerate(names)))


def affine_scan(df: DataFrame, a: Column, b: Column, out: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return scan_many(df, {out: (a, b)}, keys)


def smoothing(x: Column | str, alpha: Column | float) -> tuple[Column, Column]:
    """(a, b) of y_t = (1 - alpha) y_{t-1} + alpha x_t, starting at x_0."""
    x = F.col(x) if isinstance(x, str) else x
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return 1 - alpha, F.when(F.col("i") == 0, x).otherwise(alpha * x)


def span(x: Column | str, n: int) -> tuple[Column, Column]:
    """An EMA over n bars."""
    return smoothing(x, 2 / (n + 1))


def wilder(x: Column | str, n: int) -> tuple[Column, Column]:
    """A moving average with weight 1 / n."""
    return smoothing(x, 1 / n)


def started(x: str, n: int, keys: tuple[str, ...] = ("symbol",)) -> tuple[Column, Column]:
    """An EMA of a column that is null at first: it starts at the first known value. Rows before that yield 0."""
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy("i"))
    fresh = F.col(x).isNull() | before.isNull()
    return F.when(fresh, F.lit(0.0)).otherwise(F.lit(1 - 2 / (n + 1))), F.coalesce(F.when(fresh, F.col(x)).otherwise(F.col(x) * (2 / (n + 1))), F.lit(0.0))


def seeded(x: str, n: int) -> tuple[Column, Column]:
    """Wilder's smoothing: at row n - 1 the mean of the known values so far, then (y (n - 1) + x) / n. Rows before that yield 0."""
    first = F.avg(x).over(Window.partitionBy("symbol").orderBy("i").rowsBetween(-(n - 1), 0))
    return F.when(F.col("i") < n, F.lit(0.0)).otherwise(F.lit((n - 1) / n)), F.when(F.col("i") < n - 1, F.lit(0.0)).when(F.col("i") == n - 1, F.coalesce(first, F.lit(0.0))).otherwise(F.coalesce(F.col(x), F.lit(0.0)) / n)


def smooth(df: DataFrame, x: Column, alpha: Column | float, out: str) -> DataFrame:
    return scan_many(df, {out: smoothing(x, alpha)})


def ema(df: DataFrame, x: Column, n: int, out: str) -> DataFrame:
    return scan_many(df, {out: span(x, n)})


def rma(df: DataFrame, x: Column, n: int, out: str) -> DataFrame:
    return scan_many(df, {out: wilder(x, n)})

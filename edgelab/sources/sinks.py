"""Sinks of bars, order flow, profiles and results; each can run again without harm."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import merge_duplicate_bars, resample_bars


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_order_flow(flow: DataFrame, path: str) -> None:
    """Order-flow bars by symbol and day; days written again replace what was there, other days stay."""
    dated = flow.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")).cast("string"))
    dated.repartition("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "date").parquet(path)


def repair(raw: DataFrame, path: str, frames: dict[str, int]) -> DataFrame:
    """Write every time frame anew from the finest bars with equal stamps merged, to a new path by time frame. Returns the
    number of stamps that had to be merged, by symbol."""
    merged = merge_duplicate_bars(raw)
    fine = merged.drop("n_merged")
    for name, seconds in frames.items():
        bars = resample_bars(fine, seconds)
        bars.withColumn("tf", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf", "symbol").parquet(path)
    return merged.groupBy("symbol").agg(F.sum((F.col("n_merged") > 1).cast("long")).alias("merged"))


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the table does not hold, so that a run that was cut off goes on where it stopped; returns how many.
    With the keys known before the rows are made, `missing` spares making them."""
    spark = rows.sparkSession
    new = missing(rows, spark, path, keys)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def missing(rows: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows whose keys the table does not hold yet; all of them where there is no table."""
    return rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if _exists(spark, path) else rows


def write_results(path: str, cells: DataFrame, statistics: DataFrame, summary: dict) -> None:
    """A study's bundle: cells, null statistics (one long table) and a summary."""
    base = path.rstrip("/")
    cells.write.mode("overwrite").parquet(f"{base}/cells")
    statistics.write.mode("overwrite").parquet(f"{base}/statistics")
    cells.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/summary")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(cells, statistics, summary) of a bundle."""
    base = path.rstrip("/")
    return spark.read.parquet(f"{base}/cells"), spark.read.parquet(f"{base}/statistics"), json.loads(spark.read.text(f"{base}/summary").first()[0])


def read_csv_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of result files with a header; the schema is given, lines that do not fit it become nulls."""
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def tensor(cells: DataFrame, axes: list[str], value: str) -> DataFrame:
    """A tensor as a long table: one row for each place, with the number of its place along each axis in the order of the axis's values."""
    from pyspark.sql import Window

    x = cells
    for a in axes:
        places = cells.select(a).distinct().withColumn(f"{a}_at", F.row_number().over(Window.orderBy(a)).cast("int") - 1)  # an axis is small
        x = x.join(places, a)
    return x.select(*axes, *(f"{a}_at" for a in axes), value)

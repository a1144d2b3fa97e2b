"""Bar and tick sources: adapters, scans of delimited files, resampling, duplicate collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "ts long, open double, high double, low double, close double, volume double"
QUOTE_SCHEMA = "ts string, level tinyint, type tinyint, price double, size double, depth double, action tinyint"


def epoch_seconds(col: str):
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")


def read_csv_bars(spark: SparkSession, path: str, zone: str = "America/Chicago") -> DataFrame:
    """Bars of one file or of symbol=/tf= folders, with local time and bar number; the schema is given, never inferred."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", "true").csv(path)
    raw = raw if "symbol" in raw.columns else raw.withColumn("symbol", F.lit("-"))
    local = F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)
    return raw.withColumn("dt", local).withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Header-less day files separated by `;`, with the day of the file's name; stamps stay strings as they overflow 64 bits;
    broken lines become nulls, and files that can't be read are left out."""
    raw = spark.read.schema(QUOTE_SCHEMA).option("sep", ";").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true").csv(path)
    return raw.withColumn("file", F.input_file_name()).withColumn("day", F.regexp_extract("file", "(\\d{8})[^/]*$", 1))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from the events table: symbol, ts, seq, price, size, type (0 bid, 1 ask, 2 trade)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), epoch_seconds("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.expr("cast(coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as bigint), 0) as double)").alias("size"), F.expr("cast(pmod(user_id, 3) as int)").alias("type"))


def numbered(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")).cast("long") - 1)


def resample_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLCV bars from ticks; the label is the start of the interval, ties are ordered by seq."""
    order = F.struct("ts", "seq")
    bars = ticks.withColumn("bar", F.floor(F.col("ts") / seconds) * seconds).groupBy("symbol", "bar").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return numbered(bars.withColumnRenamed("bar", "ts"))


def resample_bars(bars: DataFrame, seconds: int, label: str = "interval") -> DataFrame:
    """Coarser bars. label: `interval` (start of the interval) or `first` (time of its first bar)."""
    b = bars.withColumn("bar", F.floor(F.col("ts") / seconds) * seconds).groupBy("symbol", "bar").agg(F.min("ts").alias("first_ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return numbered(b.withColumn("ts", F.col("bar") if label == "interval" else F.col("first_ts")).drop("bar", "first_ts"))


def merge_duplicate_bars(bars: DataFrame, seq: str = "seq") -> DataFrame:
    """One bar per time stamp: extremes, sums, first open and last close in file order; n_merged tells how many rows met."""
    return bars.groupBy("symbol", "ts").agg(F.min_by("open", seq).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", seq).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_merged"))


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return resample_ticks(event_ticks(spark, sf_dir), seconds)

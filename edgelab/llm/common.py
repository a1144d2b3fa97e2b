"""Shared helpers: table access, tables in the cluster's shared folder, label folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a local master makes one; on a
    cluster that is an error, as executors could not read each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.edgelab.sharedDir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="edgelab-")
        spark.conf.set("spark.edgelab.sharedDir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/edgelab-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgelab_path = path
    _written.append(path)
    return out


#: Paths of tables that are still there, in the order written.
_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialised within it are deleted at its end, but for those given to keep()."""
    mark, kept = len(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._edgelab_path)
        return df

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p in _written[mark:] if p not in kept]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        _written[mark:] = kept


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Python workers are sent batches of so many rows at most, which bounds their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_made: dict = {}


def made(key, make):
    """What an operator builds once in each Python worker. A worker that turns to another operator lets go of what it had."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(folds)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_ids(df: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` rows with the smallest hash of their id: a bounded sample that is the same on every run."""
    return df.filter(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it in either case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(values: pa.Array) -> list[str]:
    """A string array without nulls as Python strings, made at once rather than by way of a scalar each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings; a null is an empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same; at their end, freed memory of the Python worker goes back to the system, as it lives on for other tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000, name: str = "text", keep_made: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `chars` bytes of text at most (one row at least), to bound memory. What other
    operators made in this worker is let go of, unless this one makes something itself."""
    if not keep_made:
        _made.clear()
    for b in trimmed(batches):
        if b.num_rows == 0:
            continue
        sizes = pc.binary_length(column(b, name)).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, s in enumerate(sizes):
            if total and total + s > chars:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += s
        yield b.slice(start)


def dealt_keys(spark: SparkSession, partitions: int) -> list[int]:
    """For each partition an integer that repartition(partitions, key) sends there, so that blocks dealt by hand land evenly."""
    n = partitions
    while True:
        rows = spark.range(8 * n).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("at")).groupBy("at").agg(F.min("key").alias("key")).collect()
        if len(rows) == partitions:
            return [r["key"] for r in sorted(rows, key=lambda r: r["at"])]
        n *= 2

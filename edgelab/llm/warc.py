"""WARC archives: writing pages as records, and reading them by boundary-chain verification.

Archives are read in splits of any size. A split is cut at the magic `WARC/1.0` + CRLF, and each piece is a candidate record
with the offset where its successor would start, by its own Content-Length. Payloads may hold the magic, so candidates
need not be records: real ones are those that a chain of successors reaches from offset 0 of the file. Each split follows
its chains to where they leave it; pointer jumping over these exits, doubling its stride each round, tells where the
real chain enters every split, and the split then keeps what is reached from there. Only offsets are dealt; payload bytes
move only for records that hold the magic, which are put together again from their pieces.

Nulls: a null payload is an empty one; a null page_id is written as an empty name and read back as null, and is never
referred to (it revisits an equal payload of a page that has an id; where none has, all are responses). Payloads under
MIN_REVISIT bytes and empty ones are always responses. Repeated rows are records each; equal payloads of at least
MIN_REVISIT bytes have one response, the record with the smallest page_id (of equal ones, one with the least url), and revisits.
Extra columns are ignored; an empty table gives an empty archive. Payloads of any length are written whole. An archive whose
chain of records does not end with the file (a record without Content-Length, or a file that was cut off) is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1.0\r\n"
MIN_REVISIT = 100
#: Repeated payloads whose digests may be broadcast to the pages; beyond that they are joined by shuffling.
BROADCAST_REPEATED = 200_000
#: Revisits of repeated rows that one task writes.
REPEATS = 100_000


def write_archive(pages: DataFrame, path: str) -> None:
    """One record per row (page_id, url, html), in files under path."""
    html = F.coalesce(F.col("html"), F.lit(""))
    payload = html.cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    narrow = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("rows", "page_id").alias("ties"), F.sum("rows").alias("n")).filter("n > 1 and first is not null").drop("n")
    repeated = common.materialise(groups, "repeated-payloads")
    few = repeated.count() <= BROADCAST_REPEATED
    typed = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).withColumn("refers_to", F.when(F.col("again"), F.col("first")))
    if not repeated.filter("ties > 1").isEmpty():
        # Rows of one page_id and one payload: one is the response; the others have no payload to write, so their number is enough.
        tied = (F.coalesce(F.col("ties"), F.lit(1)) > 1) & F.col("page_id").eqNullSafe(F.col("first"))
        some, columns = typed.filter(tied), typed.columns
        counted = some.groupBy("digest", "page_id", "bytes", "first", "ties", "url").agg(F.count("*").alias("rows"))
        least = some.groupBy("digest", "page_id", "bytes", "first", "ties").agg(F.min("url").alias("url"), F.first("html").alias("html"))
        response = least.withColumn("again", F.lit(False)).withColumn("refers_to", F.lit(None).cast("long"))
        left = counted.join(least.select("digest", F.col("url").alias("least")), "digest").withColumn("rows", F.col("rows") - F.col("url").eqNullSafe(F.col("least")).cast("long"))
        parts = left.filter("rows > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / REPEATS)))).repartition(common.shuffle_partitions(pages.sparkSession))
        each = parts.withColumn("each", F.explode(F.sequence(F.lit(1), F.least(F.lit(REPEATS), F.col("rows") - F.col("part") * REPEATS))))
        others = each.withColumn("html", F.lit("")).withColumn("again", F.lit(True)).withColumn("refers_to", F.col("first"))
        typed = typed.filter(~tied).unionByName(response.select(columns)).unionByName(others.select(columns))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ")
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\nWARC-Target-URI: "), clean_url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(F.col("again"), F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit("\r\n\r\n"),
    )
    # The separator of the text writer is the end of a record.
    typed.select(F.concat(header, F.when(F.col("again"), "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at the magic. nth orders the pieces of a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("bytes"))


def _numbered(pieces: DataFrame, columns: list[str]) -> DataFrame:
    """(file, split, number in the split, columns): numbers that do not depend on how splits are dealt to tasks."""
    least = pieces.groupBy("file", "split").agg(F.min("nth").alias("least"))
    return pieces.join(least, ["file", "split"]).select("file", "split", (F.col("nth") - F.col("least")).alias("number"), *columns)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at the magic: (file, split, nth, size, head, ...) of each piece; head is the offset of the payload in it."""
    raw = _cut(spark, path)
    size = F.octet_length("bytes").cast("long")
    # Headers are ASCII but for the URI; what follows the first empty line is looked at as bytes only.
    head = F.when(F.instr(F.col("bytes").cast("string"), "\r\n\r\n") > 0, F.octet_length(F.substring_index(F.col("bytes").cast("string"), "\r\n\r\n", 1).cast("binary")).cast("long"))
    x = raw.withColumn("size", size).withColumn("head", head).withColumn("header", F.expr("cast(substring(bytes, 1, cast(head as int)) as string)"))
    field = lambda f: F.regexp_extract("header", f"(?:^|\r\n){f}: ([^\r\n]*)", 1)
    x = x.select("file", "split", "nth", "size", (F.col("head") + 4).alias("head"), F.expr("try_cast(nullif(regexp_extract(header, '(?:^|\\r\\n)Content-Length: ([0-9]+)', 1), '') as long)").alias("length"), field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("name"), field("WARC-Payload-Digest").alias("said"), F.expr("try_cast(nullif(regexp_extract(header, '(?:^|\\r\\n)WARC-Payload-Length: ([0-9]+)', 1), '') as long)").alias("said_bytes"), field("WARC-Refers-To").alias("refers"), "bytes")
    whole = (F.col("length").isNotNull()) & (F.col("size") == F.col("head") + F.col("length") + 4)
    digest = F.when(whole, F.sha2(F.expr("substring(bytes, cast(head + 1 as int), cast(length as int))"), 256))
    return x.select("file", "split", "nth", "size", "head", "length", "type", "name", "said", "said_bytes", "refers", whole.alias("whole"), digest.alias("digest"))


_CHAIN = "file string, split long, nth long, start long, next long, leaves long"


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within a split: where each candidate's chain leaves it (null if it breaks off)."""
    pdf = pdf.sort_values("start")
    start, nxt, end = pdf["start"].to_numpy(), pdf["next"].to_numpy(), int(pdf["stop"].iloc[0])
    leaves: dict[int, int] = {}
    for s, n in zip(start[::-1].tolist(), nxt[::-1].tolist()):
        leaves[s] = n if n >= end else leaves.get(n, -1)
    out = pdf[["file", "split", "nth", "start", "next"]].copy()
    out["leaves"] = [leaves[s] for s in start.tolist()]
    return out


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within a split: the candidates on the chain from its entry (rows with next null are entries)."""
    entry = set(pdf.loc[pdf["nth"] < 0, "start"].tolist())
    rows = pdf[pdf["nth"] >= 0].sort_values("start")
    keep, reach = [], set(entry)
    for s, n in zip(rows["start"].tolist(), rows["next"].tolist()):
        on = s in reach
        keep.append(on)
        if on:
            reach.add(n)
    return rows.loc[keep, ["file", "split", "nth", "start", "next"]]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every real record."""
    pieces = common.materialise(_pieces(spark, path), "pieces")
    # Offsets: sizes before a piece in its split, and before the split in its file; each piece but the last was followed by the magic.
    narrow = pieces.select("file", "split", "nth", "size", "head", "length")
    sums = narrow.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    before = sums.select("file", "split", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "total")
    own = Window.partitionBy("file", "split").orderBy("nth")
    placed = narrow.withColumn("within", F.sum(F.col("size") + len(MAGIC)).over(own) - F.col("size")).join(before, ["file", "split"])
    # `at` is where the piece begins, after its magic; a candidate starts at its magic.
    placed = common.materialise(placed.select("file", "split", "nth", (F.col("before") + F.col("within") - len(MAGIC)).alias("at"), "size", "head", "length", (F.col("before") + F.col("total") - len(MAGIC)).alias("stop")), "placed")
    candidates = placed.filter("length is not null and at > 0").select("file", "split", "nth", (F.col("at") - len(MAGIC)).alias("start"), (F.col("at") + F.col("head") + F.col("length") + 4).alias("next"), "stop")
    chains = common.materialise(candidates.groupBy("file", "split").applyInPandas(_chains, _CHAIN), "chains")
    # Nodes: where chains may enter a split; edges: where they leave it.
    exits = chains.filter("leaves >= 0").select("file", F.col("leaves").alias("start")).distinct()
    first = chains.filter("start = 0").select("file", F.lit(0).cast("long").alias("start")).distinct()
    jump = common.materialise(exits.union(first).distinct().join(chains.select("file", "start", "leaves"), ["file", "start"]).select("file", "start", F.col("leaves").alias("to")), "jumps")
    reached = common.materialise(first, "reached")
    known = reached.count()
    while known:
        ahead = jump.join(reached, ["file", "start"], "left_semi").select("file", F.col("to").alias("start")).filter("start >= 0")
        wider = common.materialise(reached.union(ahead).distinct(), "reached")
        now = wider.count()
        reached = wider
        if now == known:
            break
        known = now
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jump = common.materialise(jump.join(onward, ["file", "to"], "left").select("file", "start", F.coalesce("further", F.lit(-1).cast("long")).alias("to")), "jumps")
    entries = reached.join(chains.select("file", "start", "split"), ["file", "start"]).select("file", "split", F.lit(-1).cast("long").alias("nth"), "start", F.lit(-1).cast("long").alias("next"))
    real = common.materialise(chains.select("file", "split", "nth", "start", "next").union(entries).groupBy("file", "split").applyInPandas(_reached, "file string, split long, nth long, start long, next long"), "real")
    ends = placed.groupBy("file").agg(F.max("stop").alias("length")).join(real.groupBy("file").agg(F.max("next").alias("end")), "file", "left").filter("end is null or end <> length")
    for r in ends.limit(1).collect():
        raise ValueError(f"{r['file']}: the chain of records ends at {r['end'] or 0}, the file at {r['length']}")
    records = real.join(pieces.drop("file", "split"), "nth")
    simple = records.filter("whole").select("name", "type", "said", "said_bytes", "refers", "length", "digest")
    # Records that hold the magic: all pieces from the record to its successor, in order, with the magic between them.
    broken = common.materialise(records.filter("not coalesce(whole, false)").select("file", "start", "next", "name", "type", "said", "said_bytes", "refers", "length", F.col("head").alias("skip")), "broken")
    if not broken.isEmpty():
        # The record that each piece lies in: the last real start up to it in its file; offsets only are sorted.
        files = broken.select("file").distinct()
        upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        inside = placed.join(files, "file", "left_semi").select("file", "split", "nth", "at").join(real.select("nth", "start"), "nth", "left").withColumn("start", F.last("start", ignorenulls=True).over(upto))
        spans = common.materialise(_numbered(inside, ["at", "start"]).join(broken.select("file", "start"), ["file", "start"], "left_semi"), "spans")
        bytes_of = _numbered(_cut(spark, path), ["bytes"]).join(spans, ["file", "split", "number"])
        joined = bytes_of.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts")).select("file", "start", F.expr(f"array_join(transform(parts, p -> hex(p.bytes)), '{MAGIC.encode().hex().upper()}')").alias("content"))
        simple = simple.union(broken.join(joined, ["file", "start"]).select("name", "type", "said", "said_bytes", "refers", "length", F.sha2(F.unhex(F.expr("substring(content, cast(2 * skip + 1 as int), cast(2 * length as int))")), 256).alias("digest")))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:([^>]*)>', 1), '') as long)")
    again = F.col("type") == "revisit"
    return simple.select(number("name").alias("page_id"), F.when(again, F.col("said_bytes")).otherwise(F.col("length")).alias("payload_bytes"), F.when(again, F.regexp_replace("said", "^sha256:", "")).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.when(again, number("refers")).alias("refers_to"))

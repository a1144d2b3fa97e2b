"""Token ids as ORC: integer run-length encoded id lists, row indexes, Bloom filters on document ids.

Stripes are read in parallel, and a lookup by doc_id reads only the row groups that row indexes and Bloom filters leave.
A special token's string in a text is that token, as the library has it. Nulls: a null text encodes as an empty one, so only
the end id is written; a null doc_id sorts first. Empty texts give the end id alone, very long texts are encoded whole, equal
doc_ids are ordered by text, repeated rows are written each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordcoder import WordCoder

#: Rows between two entries of ORC's row index, and the stripe size in bytes; a reader can skip groups and stripes by them.
ROW_INDEX_STRIDE, STRIPE_BYTES, BLOOM_FPP = 1000, 32 << 20, 0.01
#: New words encoded as one text.
JOINED = 100
# White space as the tokenizer's pattern sees it (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_RUNS = re.compile(f"[{_WS}] (?:[{_WS}]|\\Z)")


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The byte-level pattern always ends a token before white space that follows other text, so the ids of a text are those
    of its words, each with the white space before it. Where single spaces are the only cuts needed, Arrow makes them;
    texts with longer runs of white space around a space are cut by a regular expression.
    """

    _by_path: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")  # a space in byte-level vocabularies
        self.coder = WordCoder(self._new, " ", "")

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with one space, before them, are encoded many at a time: the next word begins with the next token that begins with a space."""
        plain = [k for k, w in enumerate(words) if w[:1] == " " and len(w) > 1 and not w[1].isspace() and " " not in w[1:]]
        parts, starts, sizes, total = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        done = np.zeros(len(words), bool)
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            texts = ["".join([words[k] for k in some[a : a + JOINED]]) for a in range(0, len(some), JOINED)]
            ids = np.concatenate([np.array(x, np.int32) for x in self._ids(texts)])
            cut = np.flatnonzero(self.spaced[ids])
            if len(cut) == len(some) and not cut[0]:  # else a tokenizer of another kind: word by word
                starts[some], sizes[some], done[some] = total + cut, np.diff(cut, append=len(ids)), True
                parts.append(ids)
                total += len(ids)
        rest = np.flatnonzero(~done).tolist()
        for i in range(0, len(rest), 20_000):
            for k, ids in zip(rest[i : i + 20_000], self._ids([words[k] for k in rest[i : i + 20_000]])):
                starts[k], sizes[k] = total, len(ids)
                parts.append(np.array(ids, np.int32))
                total += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), starts, sizes

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        runs = [i for i, t in enumerate(texts) if _RUNS.search(t)]
        if not runs:
            return self.coder.encode(pa.array(texts, pa.string()))
        plain = list(texts)
        for i in runs:
            plain[i] = ""
        flat, offsets = self.coder.encode(pa.array(plain, pa.string()))
        parts = [flat[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        for i in runs:
            parts[i] = np.array([t for ids in self._ids(_WORDS.findall(texts[i])) for t in ids], np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each text."""
    return np.insert(flat, offsets[1:], end_id), offsets + np.arange(len(offsets))


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    encoder = WordEncoder.of(path)
    for b in common.pieces(batches):
        flat, offsets = with_end(*encoder.encode(common.text_list(b)), end_id)
        yield pa.RecordBatch.from_arrays([common.column(b, "doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])


def write_token_orc(documents: DataFrame, path: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> None:
    """Write (doc_id, ids) files in ascending order of doc_id: texts are dealt by range of doc_id, then encoded in order."""
    n = partitions or common.shuffle_partitions(documents.sparkSession)
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(lambda it: encode_batches(it, tokenizer_path, end_id), "doc_id long, ids array<int>")
    encoded.write.option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of those asked for: the ids reach the scan, which skips files' stripes and row groups by them."""
    files = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return files if doc_ids is None else files.filter(F.col("doc_id").isin(*doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = common.column(b, "ids")
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
        ends = ids.offsets.to_numpy() * 4
        view = memoryview(flat)
        crcs = [zlib.crc32(view[a:z]) for a, z in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), common.column(b, "file"), common.column(b, "pos"), pa.array((ends[1:] - ends[:-1]) // 4, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "file", "pos", "n_tokens", "ids_crc32"])


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens, ids_crc32.

    Only counts are dealt: a running sum within each file, plus the sum of the files before it. There is one row per file
    in the latter, as many as write_token_orc had partitions.
    """
    files = spark.read.schema("doc_id long, ids array<int>").orc(path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("pos"))
    rows = common.materialise(files.mapInArrow(_digests, "doc_id long, file string, pos long, n_tokens long, ids_crc32 long"), "token-index")
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "file")).alias("first"))
    before = per_file.select("file", F.coalesce(F.sum("total").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("within", within).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Per table a vector is rotated by three rounds of random signs and a fast Hadamard transform, COUNT times; each rotation
votes for the signed axis nearest to it, and the axes together are the bucket. A vector is kept in its own bucket and looks
into PROBES more, with one axis replaced by the second best. Pairs that meet within a label are verified by cosine in double
precision of the vectors as given; a pair that meets several times counts in the first table only, so counts add up without
listing pairs. A bucket with more than SPLIT vectors is compared by several tasks, one for each two of its blocks. Links found
are all true; recall against brute force is measured by the tests, on vectors of 64 numbers planted at cosines of 0.93 to 0.96.

Equal vectors of a label are one point with a multiplicity. Nulls: a null label, a null, empty or zero vector, or one with a
null or non-finite component links with nothing and is its own component; a null vec_id too. Vectors of different lengths
never link; very long ones are compared whole. Repeated rows are copies and link; repeated vec_ids keep one row each, with
what their own vectors link with. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD = 0.93
TABLES, COUNT, SEED = 4, 2, 20240917
PROBES = 1 + COUNT
#: Vectors of a bucket, or of a block of it, that one task compares.
SPLIT = 4096
#: Rows of a bucket compared at once, and pairs of them verified at once: they bound a worker's memory.
ROWS, PAIRS = 1024, 32_768


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(vectors: np.ndarray) -> np.ndarray:
    """Bucket codes [row, table, probe]; probe 0 is the vector's own bucket."""
    rows, dim = vectors.shape
    size = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dim] = vectors
    random = np.random.default_rng(SEED + dim)
    out = np.zeros((rows, TABLES, PROBES), np.uint32)
    for t in range(TABLES):
        best, second = [], []
        for _ in range(COUNT):
            x = padded
            for _ in range(3):
                x = hadamard(x * random.choice([-1.0, 1.0], size))
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            sizes = np.take_along_axis(x, top, axis=1)
            swap = np.abs(sizes[:, 0]) < np.abs(sizes[:, 1])
            top[swap], sizes[swap] = top[swap][:, ::-1], sizes[swap][:, ::-1]
            axes = 2 * top + (sizes < 0)
            best.append(axes[:, 0])
            second.append(axes[:, 1])
        for probe in range(PROBES):
            code = np.zeros(rows, np.uint32)
            for k in range(COUNT):
                code = code * np.uint32(2 * size) + (second[k] if probe == k + 1 else best[k]).astype(np.uint32)
            out[:, t, probe] = code
    return out


def _record(dim: int, number: str) -> np.dtype:
    """One vector in a bucket. block, other: the block of a split bucket that it is in, and the one that it meets (itself: within it)."""
    code = "<u2" if (2 * max(2, 1 << (dim - 1).bit_length())) ** COUNT <= 1 << 16 else "<u4"
    return np.dtype([("key", "<u8"), ("own", "u1"), ("table", "u1"), ("block", "<u2"), ("other", "<u2"), ("group", "<u4"), ("id", "<i8"), ("copies", "<i8"), ("codes", code, (TABLES, PROBES)), ("v", number, (dim,))])


def _clean(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of the numbers given; null where they link with nothing."""
    for b in common.trimmed(batches):
        vectors, labels = common.column(b, "embedding"), common.column(b, "label")
        bounds = vectors.offsets.to_numpy()
        values = vectors.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        x = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(number)
        finite = np.concatenate([[0], np.cumsum(np.isfinite(x))])[bounds]
        filled = np.concatenate([[0], np.cumsum(x != 0)])[bounds]
        good = (np.diff(finite) == np.diff(bounds)) & (np.diff(filled) > 0) & vectors.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
        out = [x[a:z].tobytes() if g else None for a, z, g in zip(bounds, bounds[1:], good)]
        yield pa.RecordBatch.from_arrays([common.column(b, "vec_id"), labels, pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _hash32(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")


def _keys(group: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The bucket of each [row, table, probe]."""
    h = group.astype(np.uint64)[:, None, None] * np.uint64(0x9E3779B97F4A7C15) + (found.astype(np.uint64) * np.uint64(TABLES) + np.arange(TABLES, dtype=np.uint64)[None, :, None])
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _coded(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[pa.RecordBatch]:
    """Each point with its group and its bucket codes."""
    width = np.dtype(number).itemsize
    for b in common.trimmed(batches):
        raw = common.column(b, "v").to_pylist()
        groups = [_hash32(f"{g}/{len(v)}") for g, v in zip(common.column(b, "label").to_pylist(), raw)]
        out: list[bytes | None] = [None] * len(raw)
        lengths = np.array([len(v) for v in raw])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            x = np.frombuffer(b"".join(raw[i] for i in at), number).reshape(len(at), length // width).astype(np.float64)
            found = codes(x / np.abs(x).max(axis=1, keepdims=True))
            for i, f in zip(at, found):
                out[i] = f.tobytes()
        yield pa.RecordBatch.from_arrays([common.column(b, "id"), common.column(b, "copies"), common.column(b, "v"), pa.array(groups, pa.int64()), pa.array(out, pa.binary())], ["id", "copies", "v", "group", "codes"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's points each bucket has."""
    for b in common.trimmed(batches):
        found = np.frombuffer(b"".join(common.column(b, "codes").to_pylist()), np.uint32).reshape(-1, TABLES, PROBES)
        key, n = np.unique(_keys(common.column(b, "group").to_numpy(), found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _deal(batches: Iterator[pa.RecordBatch], to_keys: list[int], number: str, large: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of records, each for one partition. large: buckets to split, in order, and into how many blocks."""
    width, (large_keys, large_blocks) = np.dtype(number).itemsize, large
    for b in common.trimmed(batches):
        raw = common.column(b, "v").to_pylist()
        found_all = np.frombuffer(b"".join(common.column(b, "codes").to_pylist()), np.uint32).reshape(-1, TABLES, PROBES)
        groups, ids, copies = (common.column(b, c).to_numpy() for c in ("group", "id", "copies"))
        lengths = np.array([len(v) for v in raw])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            dim = int(length) // width
            rec = np.zeros((len(at), TABLES, PROBES), _record(dim, number))
            rec["group"], rec["id"], rec["copies"] = (x[at][:, None, None] for x in (groups, ids, copies))
            rec["codes"], rec["v"] = found_all[at][:, None, None], np.frombuffer(b"".join(raw[i] for i in at), number).reshape(len(at), 1, 1, dim)
            rec["own"] = np.arange(PROBES) == 0
            rec["table"] = np.arange(TABLES)[:, None]
            rec["key"] = _keys(groups[at], found_all[at])
            flat = rec.reshape(-1)
            if len(large_keys):
                place = np.minimum(np.searchsorted(large_keys, flat["key"]), len(large_keys) - 1)
                split = large_keys[place] == flat["key"]
                if split.any():
                    some, blocks = flat[split], large_blocks[place[split]]
                    some["block"] = (_mixed(some["id"].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.uint16)
                    each = np.repeat(some, blocks)
                    each["other"] = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    low, high = np.minimum(each["block"], each["other"]).astype(np.uint64), np.maximum(each["block"], each["other"]).astype(np.uint64)
                    each["key"] = _mixed(each["key"] + _mixed(low * np.uint64(1 << 16) + high + np.uint64(1)))
                    flat = np.concatenate([flat[~split], each])
            to = (flat["key"] >> np.uint64(32)) % np.uint64(len(to_keys))
            order = np.argsort(to, kind="stable")
            flat, cut = flat[order], np.searchsorted(to[order], np.arange(len(to_keys) + 1))
            some = [p for p in range(len(to_keys)) if cut[p + 1] > cut[p]]
            yield pa.RecordBatch.from_arrays([pa.array([to_keys[p] for p in some], pa.int32()), pa.array([dim] * len(some), pa.int32()), pa.array([flat[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())], ["at", "dim", "block"])


def _first_meetings(x: np.ndarray, y: np.ndarray, bucket: int, threshold: float) -> np.ndarray:
    """Which pairs (x at home in the bucket, y at home or looking in) are links that no earlier table or place has counted."""
    u, w = x["v"].astype(np.float64), y["v"].astype(np.float64)
    u, w = u / np.abs(u).max(axis=1, keepdims=True), w / np.abs(w).max(axis=1, keepdims=True)  # no square leaves the numbers' range
    exact = (u * w).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((w * w).sum(axis=1))) >= threshold
    exact &= (x["block"] == y["block"]) == (x["block"] == x["other"])
    t, rows = x["table"].astype(np.int64), np.arange(len(x))
    exact &= (x["codes"][rows, t, 0] == bucket) & (x["table"] == y["table"])
    # Meetings of the pair in each table: the lower id at home and the higher one looking in, or the reverse.
    ahead = (x["codes"][:, :, :1] == y["codes"]).any(axis=2)  # x at home
    back = (y["codes"][:, :, :1] == x["codes"]).any(axis=2)
    earlier = np.arange(TABLES) < t[:, None]
    return exact & ~(((ahead | back) & earlier).any(axis=1) | (~(x["id"] < y["id"]) & back[rows, t]))


def _forest(parent: np.ndarray, p: list[int], q: list[int]) -> list[tuple[int, int]]:
    """Joins the sets of each pair; the pairs that joined two. Afterwards parent holds the root of every node."""
    used = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for u, w in zip(p, q):
        a, b = root(u), root(w)
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append((u, w))
    while used and (parent[parent] != parent).any():
        parent[:] = parent[parent]
    return used


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, number: str) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, links): b null for link counts of a; links 0 for one of the links that hold a bucket's components together."""
    blocks: dict[int, list[bytes]] = {}
    for b in common.trimmed(batches):
        for dim, block in zip(common.column(b, "dim").to_pylist(), common.column(b, "block").to_pylist()):
            blocks.setdefault(dim, []).append(block)
    for dim, parts in blocks.items():
        rec = np.frombuffer(b"".join(parts), _record(dim, number))
        order = np.argsort(rec["key"], kind="stable")
        key = rec["key"][order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        counted: dict[int, int] = {}
        joined: set[tuple[int, int]] = set()
        for a, n in zip(start[size > 1], size[size > 1]):
            run = rec[order[a : a + n]]
            own = run[run["own"] == 1]
            if not len(own):
                continue
            norm = lambda v: (x := v.astype(np.float64) / np.abs(v).max(axis=1, keepdims=True)) / np.sqrt((x * x).sum(axis=1, keepdims=True))
            left, right = norm(own["v"]), norm(run["v"])
            names, at_run = np.unique(run["id"], return_inverse=True)
            at_own = at_run[run["own"] == 1]
            links, parent = np.zeros(len(names), np.int64), np.arange(len(names))

            for r in range(0, len(own), ROWS):
                for c in range(0, n, ROWS):
                    i, j = np.nonzero(left[r : r + ROWS] @ right[c : c + ROWS].T >= threshold - 1e-9)
                    i, j = i + r, j + c
                    ok = (own["id"][i] != run["id"][j]) & (own["group"][i] == run["group"][j])
                    i, j = i[ok], j[ok]
                    for k in range(0, len(i), PAIRS):
                        good = _first_meetings(own[i[k : k + PAIRS]], run[j[k : k + PAIRS]], own["codes"][0, own["table"][0], 0], threshold)
                        x, y = i[k : k + PAIRS][good], j[k : k + PAIRS][good]
                        p, q = at_own[x], at_run[y]
                        np.add.at(links, p, run["copies"][y])
                        np.add.at(links, q, own["copies"][x])
                        apart = parent[p] != parent[q]  # parents are roots here
                        joined.update((int(min(names[u], names[w])), int(max(names[u], names[w]))) for u, w in _forest(parent, p[apart].tolist(), q[apart].tolist()))
            for at in np.flatnonzero(links).tolist():
                counted[int(names[at])] = counted.get(int(names[at]), 0) + int(links[at])
        pairs = sorted(joined)
        ids = list(counted)
        yield pa.RecordBatch.from_arrays([pa.array(ids + [p for p, _ in pairs], pa.int64()), pa.array([None] * len(ids) + [q for _, q in pairs], pa.int64()), pa.array([counted[i] for i in ids] + [0] * len(pairs), pa.int64())], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    with common.scratch(spark) as keep:
        return _near_duplicates(vectors, threshold, keep)


def _near_duplicates(vectors: DataFrame, threshold: float, keep) -> DataFrame:
    spark = vectors.sparkSession
    number = "<f8" if vectors.schema["embedding"].dataType.elementType.simpleString() == "double" else "<f4"
    parts = common.shuffle_partitions(spark)
    keys = common.dealt_keys(spark, parts)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    clean = given.mapInArrow(lambda it: _clean(it, number), "vec_id long, label string, v binary").withColumn("same", F.unhex(F.sha2("v", 256)))
    # Vectors travel with their digest, by which equal ones meet again.
    held = keep(common.materialise(clean, "vectors"))
    points = held.filter("v is not null and vec_id is not null").groupBy("label", "same").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    names = common.materialise(points, "vector-points")
    coded = common.materialise(names.select("id", "copies", "v", "label").mapInArrow(lambda it: _coded(it, number), "id long, copies long, v binary, group long, codes binary"), "vector-codes")
    # Buckets to split: at most TABLES * PROBES / SPLIT of all vectors.
    full = coded.select("group", "codes").mapInArrow(_buckets, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > SPLIT).toArrow()
    order = np.argsort(full.column("key").to_numpy().view(np.uint64))
    blocks = np.minimum(-(-full.column("n").to_numpy() // SPLIT), (1 << 16) - 1)
    large = spark.sparkContext.broadcast((full.column("key").to_numpy().view(np.uint64)[order], blocks[order]))
    met = common.materialise(coded.mapInArrow(lambda it: _deal(it, keys, number, large.value), "at int, dim int, block binary").repartition(parts, "at").mapInArrow(lambda it: _compare(it, threshold, number), "a long, b long, links long"), "vector-links")
    named = components(met.filter("b is not null"))
    counted = met.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = names.drop("v").join(counted, F.col("id") == counted["a"], "left").join(named, F.col("id") == named["node"], "left")
    known = keep(common.materialise(known.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-names"))
    lone = F.col("same").isNull() | F.col("vec_id").isNull()
    out = held.select("vec_id", F.when(~lone, F.col("label")).alias("label"), F.when(~lone, F.col("same")).alias("same")).join(known, ["label", "same"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

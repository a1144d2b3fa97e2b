"""Exact Jaccard join of word shingles by metric-space partitioning with pivots.

Jaccard distance is a metric, but between texts that share nothing all distances are 1, and no document tells two others
apart: windows around document pivots would hold everything (figures in the README). So less is asked of the top level:
its pivots are parts of sets. The hash universe of shingles is cut into m classes, and what a document has in a class is
its part; a pivot is one (class, part), and the documents at distance 0 from it within the class are its region. Linked
sets differ in at most delta = (1-t)/(1+t) * (n+n') shingles, so with m > delta classes at least m - delta parts of both
are the same: replicating a document into the regions of all its parts (and, at the edge of its size range, also into
those of the range below) loses no link.

Below that, regions join recursively with documents as pivots:

1. The least member of a region is its first pivot: all others are compared with it, and those within the threshold are
   contracted to one component with it. The pivot is then done.
2. A pair that has met no such pivot shares at least s regions in which neither is the pivot, s being what the pigeonhole
   leaves when m - delta parts are shared. So a document stays in all but its s - 1 largest regions, and one with fewer
   than s of them leaves all (rows of ids only; no texts travel).
3. Regions that still hold two components are joined in the metric space of sketches (1,024 classes, counted modulo 2:
   their Hamming distance is at most the symmetric difference). Pivots cut a region into Voronoi cells; a document is
   replicated into each cell whose pivot is no farther than its own by twice the largest difference of a link
   (triangle inequality); cells join the same way until they are small, large ones over many tasks. Of each two components that meet
   in a cell the nearest pair is compared exactly, links are contracted, then more, and at last all that are left.

A region never travels with its texts; only pairs that pass the windows do, compressed. Copies (equal sets) are one point.

Null and empty texts have no shingles and link with nothing. Texts with fewer words than a shingle are one shingle, the
whole sequence. Repeated doc_ids keep one row each and share the component of their texts; a null doc_id gets a component
of its own text but never names one unless it is alone (then null). Extra columns are ignored; an empty table gives an
empty result. Very long texts are cut into words whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 5, 80
#: Documents (or pairs of them) whose ids may be broadcast to their texts; beyond that they are joined by shuffling.
BROADCAST_IDS = 500_000
#: Rows to drop whose keys (8 bytes each) may be broadcast to the documents; beyond that they are joined by shuffling.
BROADCAST_ROWS = 2_000_000
#: Letters of text that a Python worker describes or compares at a time (one text at least), and rows it is sent at a time.
LETTERS, ROWS = 400_000, 500
WINDOW_LONGS = 16
#: Texts that one task compares with another one.
STAR = 500
#: Members of a cell that one task joins (a region with more is cut over many tasks first), members compared without more
#: pivots, pivots of a level, levels of distributed cuts, and how many pairs of two components are compared in each round (None: all).
CELL, SMALL, PIVOTS, LEVELS, NEAREST = 1024, 48, 6, 3, (1, 64, None)
#: The column of row keys in keep_one.
_ROW = "edgelab_row"
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = _BYTES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = _U(0xD6E8FEB86659FD93)
_R_INV = _U(pow(int(_R), -1, 1 << 64))
_powers = (np.ones(1, _U), np.ones(1, _U))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size, r, _U))]) for r in (_R, _R_INV))
    return _powers


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(begin):
        return [np.zeros(0, _U) for _ in texts]
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[data] * up[: len(data)])])
    word = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U) * _U(0x9E3779B97F4A7C15))
    bounds = np.concatenate([[1], 1 + np.cumsum([len(r) + 1 for r in raw])])
    edges = np.searchsorted(begin, bounds)
    k = WORDS
    if len(word) >= k:
        rolled = np.zeros(len(word) - k + 1, _U)
        for i in range(k):
            rolled = rolled * _R + word[i : len(word) - k + 1 + i]
        rolled = mix(rolled + _U(k))
    out = []
    for a, z in zip(edges[:-1], edges[1:]):
        if z - a >= k:
            out.append(np.unique(rolled[a : z - k + 1]))
        elif z > a:
            h = np.zeros(1, _U)
            for w in word[a:z]:
                h = h * _R + w
            out.append(mix(h + _U(z - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def size_ranges(longest: int, percent: int = PERCENT) -> list[int]:
    """Lower bounds of the size ranges; linked sets lie in the same range or in neighbouring ones."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


def regions(u: np.ndarray, ranges: list[int], percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The regions of a set, as hashes of (size range, class, part), and how many of them any linked set surely shares."""
    n = len(u)
    b = int(np.searchsorted(ranges, n, "right")) - 1
    mixed = mix(u ^ _U(0xA5A5A5A5A5A5A5A5))
    out, shared = [], []
    for r in (b, b - 1):
        if r < 0 or (r < b and n * percent > 100 * (ranges[b] - 1)):
            continue
        top = ranges[r + 1] - 1  # the largest set of this range; its partners have top * 100 / percent at most
        delta = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        if delta == 0:
            continue  # only equal sets link, and they are one point
        m = delta + 5 + delta // 20
        part = (u % _U(m)).astype(np.int64)
        content = np.zeros(m, _U)
        np.add.at(content, part, mixed)
        filled = np.bincount(part, minlength=m) > 0
        keys = mix(content + mix(np.arange(m, dtype=_U) + _U(r) * _U(0x100000001)))
        empty = m - int(filled.sum())
        out.append(keys if empty >= m - delta else keys[filled])  # parts that are empty count only where nothing else need be shared
        shared.append(1 if empty >= m - delta else m - delta - empty)
    return (np.concatenate(out), min(shared)) if out else (np.zeros(0, _U), 1)


def window(u: np.ndarray) -> np.ndarray:
    """Counts of the set in 1,024 classes modulo 2; two sets differ in at least as many shingles as bits."""
    counts = np.bincount((mix(u + _U(0x1234567)) % _U(64 * WINDOW_LONGS)).astype(np.int64), minlength=64 * WINDOW_LONGS)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8")


def point(u: np.ndarray) -> int:
    """One id for equal sets."""
    return int((np.sum(mix(u)) + mix(np.array([len(u)], _U)))[0].view(np.int64)) if len(u) else 0


_POINT = "doc_id {id}, point long, n long, " + ", ".join(f"w{i} long" for i in range(WINDOW_LONGS))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document."""
    names = ["doc_id", "point", "n", *(f"w{i}" for i in range(WINDOW_LONGS))]
    for b in common.pieces(batches, LETTERS):
        sets = shingle_sets(common.text_list(b))
        windows = np.array([window(u) for u in sets], np.int64).reshape(len(sets), WINDOW_LONGS)
        yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array([point(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64()), *(pa.array(np.ascontiguousarray(windows[:, i])) for i in range(WINDOW_LONGS))], names)


def _deal(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    """Blocks of regions; each block goes to one partition as a whole. Made from the texts while they are shuffled, as written they would take as much again."""
    parts, known = len(keys), set()
    for b in common.pieces(batches, LETTERS):
        sets = shingle_sets(common.text_list(b))
        points = np.array([point(u) for u in sets], np.int64)
        sizes = np.array([len(u) for u in sets], np.int64)
        ranges = size_ranges(int(sizes.max(initial=1)))
        if len(known) > 200_000:
            known.clear()
        fresh = []
        for i, p in enumerate(points.tolist()):  # copies within a task need their regions once
            if sizes[i] and p not in known:
                known.add(p)
                fresh.append(i)
        both = [regions(sets[i], ranges) for i in fresh]
        found, shared = [f for f, _ in both], np.array([min(n, 255) for _, n in both], np.uint8)
        if not found or not sum(map(len, found)):
            continue
        key = np.concatenate(found)
        owner = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f) for f in found])
        to = ((key >> _U(32)) % _U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, owner, to = key[order], owner[order], to[order]
        cut = np.searchsorted(to, np.arange(parts + 1))
        table = points[fresh]
        rows = []
        for p in range(parts):
            a, z = cut[p], cut[p + 1]
            if z > a:
                own, count = np.unique(owner[a:z], return_counts=True)
                rows.append((keys[p], _pack_block(table[own], shared[own], count, key[a:z])))
        k, blocks = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(blocks, pa.binary())], ["at", "block"])


def _pack_block(members: np.ndarray, shared: np.ndarray, counts: np.ndarray, key: np.ndarray) -> bytes:
    """Members, what each shares with any link, how many regions each has, and the regions' lower 48 bits in order of the members."""
    low = key.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]
    width = 1 if counts.max() < 256 else 4
    return np.array([len(members), width], "<u4").tobytes() + members.astype("<i8").tobytes() + shared.tobytes() + counts.astype(f"<u{width}").tobytes() + low.tobytes()


def _unpack_block(at: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(regions, members, shared). A region is named by its lower 48 bits and where it was dealt; two that share a name only make more pairs to compare."""
    n, width = map(int, np.frombuffer(block, "<u4", 2))
    low = np.frombuffer(block[8 + (9 + width) * n :], "<u2").reshape(-1, 3)
    key = np.full((len(low), 4), at & 0xFFFF, "<u2")
    key[:, :3] = low
    counts = np.frombuffer(block, f"<u{width}", n, 8 + 9 * n)
    return key.view("<u8")[:, 0], np.repeat(np.frombuffer(block, "<i8", n, 8), counts), np.repeat(np.frombuffer(block, "u1", n, 8 + 8 * n), counts)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the regions dealt here: pairs (least member, other member), and the other members of regions of three and more.
    Regions with the same members are named once, with how many they are."""
    got = [_unpack_block(at, x) for b in common.trimmed(batches) for at, x in zip(common.column(b, "at").to_pylist(), common.column(b, "block").to_pylist())]
    if not got:
        return
    key, member, shared = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.lexsort((member, key))
    key, member, shared = key[order], member[order], shared[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member, shared = key[keep], member[keep], shared[keep]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    several = np.repeat(size >= 2, size)
    key, member, shared = key[several], member[several], shared[several]
    if not len(key):
        return
    size = size[size >= 2]
    start = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        content = np.add.reduceat(mix(member.view(_U)), start)
    _, one, times = np.unique(np.stack([content, size.astype(_U)]), axis=1, return_index=True, return_counts=True)
    chosen = np.zeros(len(size), bool)
    chosen[one] = True
    repeated = np.zeros(len(size), np.int32)
    repeated[one] = times
    keep = np.repeat(chosen, size)
    region, member, shared, size, repeated = np.repeat(key[start].view(np.int64), size)[keep], member[keep], shared[keep], size[chosen], repeated[chosen]
    start = np.cumsum(size) - size
    least = np.repeat(member[start], size)
    other = np.ones(len(member), bool)
    other[start] = False
    pairs = np.unique(np.stack([least[other], member[other]]), axis=1)
    large = np.repeat(size >= 3, size) & other
    rows = [np.zeros(pairs.shape[1], np.int32)] * 3, [x.astype(np.int32)[large] for x in (shared, np.repeat(repeated, size), np.repeat(size, size))]
    for a, b, kind, extra in ((pairs[0], pairs[1], 0, rows[0]), (region[large], member[large], 1, rows[1])):
        for i in range(0, len(a), 200_000):
            x = [c[i : i + 200_000] for c in (a, b, np.full(len(a), kind, np.int8), *extra)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["a", "b", "kind", "shared", "times", "size"])


def _reach(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of a set of n and a set linked with it."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def _near(words: np.ndarray, n: np.ndarray, component: np.ndarray, core: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members in different components that pass the windows, one of them at home in the cell, and the distances of
    their sketches. Cells are cut by pivots until they are small, or pivots no longer part them."""
    out = []

    def distances(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[i][:, None, :] ^ words[j][None, :, :]).sum(axis=2, dtype=np.int32)

    def compare(members: np.ndarray, home: np.ndarray) -> None:
        for a in range(0, len(members), 256):
            i = members[a : a + 256]
            for c in range(a, len(members), 256):
                j = members[c : c + 256]
                d = distances(i, j)
                total = n[i][:, None] + n[j][None, :]
                ok = (d * (100 + percent) <= total * (100 - percent)) & (component[i][:, None] != component[j][None, :]) & (home[a : a + 256][:, None] | home[c : c + 256][None, :])
                ok &= 100 * np.minimum(n[i][:, None], n[j][None, :]) >= percent * np.maximum(n[i][:, None], n[j][None, :])
                if a == c:
                    ok &= np.triu(np.ones(ok.shape, bool), 1)
                x, y = np.nonzero(ok)
                out.append((i[x], j[y], d[x, y]))

    def join(members: np.ndarray, home: np.ndarray) -> None:
        if not home.any() or (component[members] == component[members[0]]).all():
            return
        if len(members) <= SMALL:
            return compare(members, home)
        # Pivots far from each other: the first member, then always the one farthest from those before.
        pivots, far = [0], None
        for _ in range(PIVOTS - 1):
            d = distances(members[pivots[-1:]], members)[0]
            far = d if far is None else np.minimum(far, d)
            pivots.append(int(far.argmax()))
        d = distances(members, members[pivots])
        own = d.argmin(axis=1)
        window = d.min(axis=1) + 2 * _reach(n[members], percent)
        held = d <= window[:, None]
        if held.sum() > 2 * len(members):
            return compare(members, home)
        for p in range(PIVOTS):
            cell = held[:, p]
            join(members[cell], home[cell] & (own[cell] == p))

    join(np.arange(len(n)), core)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _join_cells(batches: Iterator[pa.RecordBatch], percent: int, nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Of cells that come one after another: for each two components the nearest pairs (all where nearest is None), each pair
    once a batch, and the region as `more` where there were more of them."""
    names = ["cell", "region", "point", "component", "n", "core", *(f"w{i}" for i in range(WINDOW_LONGS))]

    def done(rows: np.ndarray) -> pa.RecordBatch:
        region, point, component, n, core, words = rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5] > 0, np.ascontiguousarray(rows[:, 6:]).view(_U)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]]))
        found = [[], [], []]
        for a, z in zip(starts[:-1], starts[1:]):
            i, j, d = _near(words[a:z], n[a:z], component[a:z], core[a:z], percent)
            if not len(i):
                continue
            i, j = i + a, j + a
            low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
            order = np.lexsort((point[i] ^ point[j], d, high, low))
            first = np.flatnonzero(np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
            take = np.ones(len(order), bool) if nearest is None else rank < nearest
            last = np.zeros(len(order), bool)
            if nearest is not None:
                last[:-1] = (rank[:-1] == nearest - 1) & (rank[1:] == nearest)
            i, j, more = i[order][take], j[order][take], last[take]
            for k, x in enumerate((np.minimum(point[i], point[j]), np.maximum(point[i], point[j]), np.where(more, region[i], 0))):
                found[k].append(x)
        pairs = np.unique(np.stack([np.concatenate(x) for x in found]), axis=1) if found[0] else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2], mask=pairs[2] == 0)], ["a", "b", "more"])

    held = np.zeros((0, len(names)), np.int64)
    for b in common.trimmed(batches):
        rows = np.stack([common.column(b, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
        rows = np.concatenate([held, rows])
        last = np.flatnonzero(rows[:, 0] != rows[-1, 0]) if len(rows) else []
        cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
        if cut:
            yield done(rows[:cut])
        held = rows[cut:]
    if len(held):
        yield done(held)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Point and compressed text; of the copies within a task, one."""
    packer, seen = zstandard.ZstdCompressor(), set()
    for b in common.pieces(batches, LETTERS):
        texts = common.text_list(b)
        new = {}
        for u, t in zip(shingle_sets(texts), texts):
            p = point(u)
            if len(u) and p not in seen:
                new.setdefault(p, packer.compress(t.encode("utf-8", "surrogatepass")))
        if len(seen) > 200_000:
            seen.clear()
        seen.update(new)
        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["point", "packed"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stars one after another: the text of a (b is null), then those of the b's compared with it; the pairs that link."""
    unpacker, held = zstandard.ZstdDecompressor(), np.zeros(0, _U)
    for b in common.trimmed(batches):
        packed, left, right = common.column(b, "packed"), common.column(b, "a").to_pylist(), common.column(b, "b").to_pylist()
        found, start = [], 0
        while start < b.num_rows:
            texts, letters = [], 0
            while start + len(texts) < b.num_rows and letters <= LETTERS:
                texts.append(unpacker.decompress(packed[start + len(texts)].as_py()).decode("utf-8", "surrogatepass"))
                letters += len(texts[-1])
            for i, x in enumerate(shingle_sets(texts), start):
                if right[i] is None:
                    held = x
                    continue
                same = len(np.intersect1d(held, x, assume_unique=True))
                if same and 100 * same >= percent * (len(held) + len(x) - same):
                    found.append(i)
            start += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in found], pa.int64()), pa.array([right[i] for i in found], pa.int64())], ["a", "b"])


def _window_holds(a: str, b: str, percent: int):
    """No less than what sizes and windows ask of linked sets."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(WINDOW_LONGS)])
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (bits * (100 + percent) <= (small + large) * (100 - percent))


def _left_over(met: DataFrame) -> DataFrame:
    """(region, point) of what may link with another member than the region's first pivot. Two that do and have met no first
    pivot share `shared` regions at least, so under one order of regions they also meet in one that is not among the last shared - 1 of either."""
    rows = met.filter("kind = 1").select(F.col("a").alias("region"), F.col("b").alias("point"), "shared", "times", "size")
    w = Window.partitionBy("point")
    ordered = w.orderBy("size", "region")
    counted = rows.withColumn("all", F.sum("times").over(w)).withColumn("upto", F.sum("times").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("least", F.min("shared").over(w))
    return counted.filter("upto - times <= all - least").select("region", "point")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows of those groups that hold more than one component."""
    several = rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(key)
    return rows.join(several, key)


def _cut(active: DataFrame, percent: int) -> DataFrame:
    """Cells of at most about CELL members, each whole in one partition and in order. Regions with more are cut into Voronoi
    cells by pivots, with triangle windows; what pivots don't part goes in blocks: the largest component against the others."""
    words = [f"w{i}" for i in range(WINDOW_LONGS)]
    cells = active.select(F.col("region").alias("cell"), "region", "point", "component", "n", F.lit(1).alias("core"), *words)
    small, level = [], 0
    while True:
        sized = cells.join(cells.groupBy("cell").agg(F.count("*").alias("size")), "cell")
        small.append(sized.filter(F.col("size") <= CELL).drop("size"))
        large = sized.filter(F.col("size") > CELL)
        if large.isEmpty():
            break
        if level == LEVELS:
            small.append(_blocks(large.drop("size")))
            break
        level += 1
        large = common.materialise(large.drop("size"), "large-cells")
        # Pivots by hash, one of each of PIVOTS shares of the members, so that no group is gathered.
        mark = F.xxhash64("point", F.lit(level))
        share = large.groupBy("cell", F.pmod(mark, F.lit(PIVOTS)).alias("share")).agg(F.min_by(F.array(*words), mark).alias("words"))
        pivots = share.groupBy("cell").agg(F.sort_array(F.collect_list("words")).alias("pivots"))
        differ = F.transform("pivots", lambda p: reduce(lambda x, y: x + y, [F.bit_count(p[i].bitwiseXOR(F.col(w))) for i, w in enumerate(words)]))
        dealt = large.join(pivots, "cell").withColumn("far", differ).drop("pivots").withColumn("near", F.array_min("far"))
        reach = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
        if dealt.agg(F.sum(F.size(F.filter("far", lambda d: d <= F.col("near") + 2 * reach)))).first()[0] > 2 * large.count():
            small.append(_blocks(large))  # the windows hold too much: pivots do not part these
            break
        dealt = dealt.select("*", F.posexplode("far").alias("at", "distance")).filter(F.col("distance") <= F.col("near") + 2 * reach)
        home = (F.col("core") == 1) & (F.col("at") == F.array_position("far", F.col("near")) - 1)
        cells = _mixed(dealt.select(F.xxhash64("cell", "at").alias("cell"), "region", "point", "component", "n", home.cast("int").alias("core"), *words), "cell")
        cells = common.materialise(cells, "cells")
    whole = reduce(DataFrame.unionByName, small)
    return whole.repartition(common.shuffle_partitions(active.sparkSession), "cell").sortWithinPartitions("cell", "point")


def _blocks(large: DataFrame) -> DataFrame:
    """Blocks of the largest component against blocks of all others, and blocks of those against each other: rows in
    proportion to the cell while few are left outside its largest component."""
    sizes = large.groupBy("cell", "component").agg(F.count("*").alias("k"))
    top = sizes.groupBy("cell").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"))
    blocks = top.select("cell", "top", F.ceil(F.col("most") / CELL).alias("tops"), F.ceil((F.col("all") - F.col("most")) / CELL).alias("others"))
    rows = large.join(blocks, "cell").withColumn("block", F.when(F.col("component") == F.col("top"), F.pmod(F.xxhash64("point"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("point"), F.col("others"))))
    other = F.col("component") != F.col("top")
    against = F.transform(F.sequence(F.lit(0), F.when(other, F.col("tops")).otherwise(F.col("others")) - 1), lambda j: F.xxhash64("cell", F.when(other, j).otherwise(F.col("block")), F.when(other, F.col("block")).otherwise(j)))
    apart = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("cell", F.lit("others"), F.least(j, F.col("block")), F.greatest(j, F.col("block"))))
    to = F.explode(F.when(other & (F.col("others") > 1), F.concat(against, apart)).otherwise(against)).alias("cell")
    return rows.select("region", "point", "component", "n", other.cast("int").alias("core"), *(f"w{i}" for i in range(WINDOW_LONGS)), to)


def join_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = documents.sparkSession
    with common.arrow_rows(spark, ROWS), common.scratch(spark) as keep:
        return _join(documents, percent, keep)


def _join(documents: DataFrame, percent: int, keep) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    parts = common.shuffle_partitions(spark)
    keys = common.dealt_keys(spark, parts)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = keep(common.materialise(docs.mapInArrow(_describe, _POINT.format(id=kind)), "described"))
    met = common.materialise(docs.select("text").mapInArrow(lambda it: _deal(it, keys), "at int, block binary").repartition(parts, "at").mapInArrow(_meet, "a long, b long, kind byte, shared int, times int, size int"), "met")
    points = common.materialise(rows.filter("n > 0").groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.first(f"w{i}").alias(f"w{i}") for i in range(WINDOW_LONGS))), "points")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of points that link, by exact comparison of their texts."""
        with common.scratch(spark) as hold:
            whole = pairs.select("a", "b").join(points.select(F.col("point").alias("a"), F.struct("doc_id", "n", *(f"w{i}" for i in range(WINDOW_LONGS))).alias("x")), "a").join(points.select(F.col("point").alias("b"), F.struct("doc_id", "n", *(f"w{i}" for i in range(WINDOW_LONGS))).alias("y")), "b")
            near = common.materialise(whole.filter(_window_holds("x", "y", percent)).select("a", "b", F.col("x.doc_id").alias("doc_a"), F.col("y.doc_id").alias("doc_b")), "near")
            chosen = common.materialise(near.groupBy("b").agg(F.min(F.struct("a", "doc_a", "doc_b")).alias("x")).select("x.a", "b", "x.doc_a", "x.doc_b"), "chosen")
            one = compared(chosen)
            of = components(one)
            left, right = (of.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
            apart = near.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            both = one.unionByName(compared(common.materialise(apart.select("a", "b", "doc_a", "doc_b").join(chosen.select("a", "b"), ["a", "b"], "left_anti"), "apart")))
            return hold(common.materialise(both, "linked"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose texts link."""
        ids = pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b")).distinct()
        few = max(ids.count(), pairs.count()) <= BROADCAST_IDS
        found = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        if not ids.filter("doc_id is null").isEmpty():  # texts that only rows with a null doc_id have
            found = found.unionByName(docs.filter("doc_id is null"))
        texts = common.materialise(found.mapInArrow(_compress, "point long, packed binary"), "texts")
        if not texts.groupBy("point").count().filter("count > 1").isEmpty():  # a doc_id that several rows have
            texts = common.materialise(texts.dropDuplicates(["point"]), "texts")
        # Stars: a text goes once to the tasks that compare it, with at most about STAR others in each; no text is repeated by pair.
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("slots"))
        ends = common.materialise(pairs.select("a", "b").join(sizes, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots"))).select("a", "b", "slot"), "stars")
        some = lambda df: F.broadcast(df) if few else df
        centres = texts.join(some(ends.select("a", "slot").distinct()), F.col("point") == F.col("a")).select("a", "slot", F.lit(None).cast("long").alias("b"), "packed")
        others = texts.join(some(ends), F.col("point") == F.col("b")).select("a", "slot", "b", "packed")
        stars = centres.unionByName(others).repartition(parts, "a", "slot").sortWithinPartitions("a", "slot", F.asc_nulls_first("b"))
        return common.materialise(stars.mapInArrow(lambda it: _verify(it, percent), "a long, b long"), "compared")

    first = linked(met.filter("kind = 0").select("a", "b").distinct())
    rest = common.materialise(_left_over(met), "rest")
    links = first
    for nearest in NEAREST:
        with common.scratch(spark) as hold:
            meets = _mixed(rest.join(components(links).withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point")), "region")
            active = common.materialise(meets.join(points.drop("doc_id"), "point"), "active")
            pairs = common.materialise(_cut(active, percent).mapInArrow(lambda it, k=nearest: _join_cells(it, percent, k), "a long, b long, more long"), "cell-pairs")
            if pairs.isEmpty():
                break
            links = hold(common.materialise(links.unionByName(linked(pairs.select("a", "b").distinct())), "links"))
            rest = hold(common.materialise(rest.join(pairs.filter("more is not null").select(F.col("more").alias("region")).distinct(), "region", "left_semi"), "rest"))
    named = components(links).select(F.col("node").alias("point"), "component")
    labelled = points.select("point", "doc_id").join(named, "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_point = keep(common.materialise(labelled.select("point", "component").join(least, "component").select("point", "component_id"), "of-point"))
    return rows.select("doc_id", "point", F.col("n").alias("n_shingles")).join(of_point, "point", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _keyed(documents: DataFrame, keep) -> DataFrame:
    """The rows with a key of each row's own as _ROW, which is the same whenever they are read. In a table of Parquet files it is
    where the row lies; any other table is written down, as it need not come in the same order twice."""
    plan = documents._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    files = kind(plan) == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation" and kind(plan.relation().fileFormat()) == "ParquetFileFormat"
    if not (files and plan.relation().location().rootPaths().size() == 1):  # of several paths, two may lead to one file
        return keep(common.materialise(documents.withColumn(_ROW, F.monotonically_increasing_id()), "keyed"))
    file, number = common.free_names(documents.columns, "file", "number")
    at = documents.metadataColumn("_metadata")
    names = sorted(r[0] for r in documents.select(at["file_path"]).distinct().collect())  # a row for each file
    files = documents.sparkSession.createDataFrame(list(enumerate(names)), f"`{number}` long, `{file}` string")
    return documents.withColumns({_ROW: at["row_index"], file: at["file_path"]}).join(F.broadcast(files), file).withColumn(_ROW, F.shiftleft(number, 40) + F.col(_ROW)).drop(file, number)


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component. Rows with a null doc_id count as any other, rows without shingles are alone."""
    spark = documents.sparkSession
    with common.scratch(spark) as keep:
        keyed = _keyed(documents, keep)  # the keys stand for doc_id
        found = join_components(keyed.select(F.col(_ROW).alias("doc_id"), "text"), percent)
        dropped = keep(common.materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(_ROW)), "dropped"))
        few = dropped.count() <= BROADCAST_ROWS  # then no text is dealt
    return keyed.join(F.broadcast(dropped) if few else dropped, _ROW, "left_anti").select(*documents.columns)

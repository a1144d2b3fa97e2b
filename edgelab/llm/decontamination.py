"""Benchmark decontamination: BM25 with block-max WAND over test items, then question and answer overlap.

The inverted index holds the test items; every passage of every document is a query. An item's BM25 impacts are divided
by their sum, so a passage that holds all its words scores 1, and THRESHOLD is a share of the item. A passage whose
terms' best impacts cannot sum up to the threshold retrieves nothing, which is WAND's own bound and is tested for all
passages at once; the rest run block-max WAND, and all items at or above the threshold are retrieved. A hit needs the
five-word shingles of the item to be found in the passage: a share of OVERLAP of question and answer together, and of
LEAST_PART of each. The answer is the item's last sentence if it has more than one.

Words are lower-cased pieces between white space without signs at their ends. Passages are windows twice as long as the
longest item of a block, advancing by half, so that each occurrence of an item, however long, lies within one; very long
texts are searched whole. Null and empty texts match nothing; items without a word are ignored; repeated rows give repeated
hits, and rows with a null doc_id hits with a null one; a part shorter than five words counts as one shingle. An empty table
on either side gives no hits. Extra columns are ignored, whatever their names. Items are indexed in blocks of ITEM_BLOCK items or
BLOCK_WORDS words, one pass over the documents each, so that an index stays small; document frequencies and the mean length
are those of all items, so that a score does not depend on the blocks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

THRESHOLD, OVERLAP, LEAST_PART, SHINGLE = 0.6, 0.8, 0.5, 5
K1, B = 1.2, 0.75
POSTING_BLOCK, ITEM_RANGES, ITEM_BLOCK, BLOCK_WORDS = 16, 64, 20_000, 2_000_000
#: Bytes of text that a Python worker searches at a time (one text at least).
LETTERS = 1_000_000
#: Terms of distinct tokens a Python worker keeps at most.
CACHE_WORDS = 200_000
_EDGES = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def term(token: str) -> str:
    return _EDGES.sub("", token.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def parts_of(text: str | None) -> list[list[str]]:
    """Words of each sentence that has any."""
    cut = [[t for t in map(term, s.split()) if t] for s in _SENTENCE.split((text or "").strip())]
    return [p for p in cut if p]


class Statistics:
    """Number of items, their mean length, and how many items hold each term."""

    def __init__(self, texts: Iterable[str | None]):
        self.items, words, self.holding = 0, 0, Counter()
        for text in texts:
            own = [t for p in parts_of(text) for t in p]
            if own:
                self.items += 1
                words += len(own)
                self.holding.update(set(own))
        self.mean = words / max(self.items, 1)


class Index:
    """Postings in blocks, with the greatest impact of each block and term."""

    def __init__(self, items: list[tuple[object, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics(t for _, t in items)
        kept = []
        for key, text in sorted(items, key=lambda x: (str(x[0]), x[1] or "")):
            parts = parts_of(text)
            if parts:
                question = [t for p in (parts[:-1] or parts) for t in p]
                kept.append((key, [t for p in parts for t in p], question, parts[-1] if len(parts) > 1 else []))
        self.keys = [k for k, *_ in kept]
        self.words = [w for _, w, _, _ in kept]
        self.parts = [(shingles(q), shingles(a)) for _, _, q, a in kept]
        self.longest = max((len(w) for w in self.words), default=1)
        n, mean, df = statistics.items, statistics.mean, {t: statistics.holding[t] for w in self.words for t in w}
        idf = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((i, x / whole))
        self.ids = {t: k for k, t in enumerate(sorted(postings))}
        self.items = [[i for i, _ in postings[t]] for t in sorted(postings)]
        self.impacts = [[x for _, x in postings[t]] for t in sorted(postings)]
        self.block_max = [[max(x[a : a + POSTING_BLOCK]) for a in range(0, len(x), POSTING_BLOCK)] for x in self.impacts]
        self.bound = np.array([max(x) for x in self.impacts] + [0.0])  # the last: no term of any item
        # Greatest impact of each term in each range of items: a passage's sums over its terms bound all scores of a range.
        wide = max(1, -(-len(kept) // ITEM_RANGES))
        self.range_max = np.zeros((len(self.ids) + 1, -(-len(kept) // wide) if kept else 1), np.float32)
        for t, (own, x) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.range_max[t], np.array(own) // wide, np.array(x, np.float32))

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items with a score of the threshold or more, for distinct terms."""
        items, impacts, block_max, bound = self.items, self.impacts, self.block_max, self.bound
        cursors = [[items[t][0], t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += bound[c[1]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            block_total, block_end = 0.0, len(self.keys)
            for c in cursors[: pivot + 1]:
                t = c[1]
                b = c[2] // POSTING_BLOCK
                while b < len(block_max[t]) and items[t][min((b + 1) * POSTING_BLOCK, len(items[t])) - 1] < at:
                    b += 1
                if b < len(block_max[t]):
                    block_total += block_max[t][b]
                    block_end = min(block_end, items[t][min((b + 1) * POSTING_BLOCK, len(items[t])) - 1])
            if block_total >= threshold:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._advance(c, at)
                    if c[0] == at:
                        score += impacts[c[1]][c[2]]
                if score >= threshold:
                    found.append((at, score))
                to = at + 1
            else:
                to = block_end + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, at + 1)
            for c in cursors[: pivot + 1]:
                self._advance(c, to)
            cursors = [c for c in cursors if c[2] < len(items[c[1]])]
        return found

    def _advance(self, cursor: list, to: int) -> None:
        own, p = self.items[cursor[1]], cursor[2]
        while p < len(own) and own[p] < to:
            p += 1
        cursor[2] = p
        cursor[0] = own[p] if p < len(own) else len(self.keys)


class Matcher:
    def __init__(self, index: Index, threshold: float = THRESHOLD):
        self.index, self.threshold, self.memo = index, threshold, {}
        self.bounded = self.searched = 0  # passages that the term bounds let through, and those searched

    def _term(self, token: str) -> tuple[str, int]:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > CACHE_WORDS:
                self.memo.clear()
            t = term(token)
            got = self.memo[token] = (t, self.index.ids.get(t, -1) if t else -2)
        return got

    def hits(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every hit, one per row and item."""
        index = self.index
        rows = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = rows.flatten().dictionary_encode()
        offsets = rows.offsets.to_numpy().astype(np.int64) - rows.offsets[0].as_py()
        terms = [self._term(t) for t in common.strings(coded.dictionary)]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = np.fromiter((i for _, i in terms), np.int64, len(terms))[codes] if len(terms) else np.zeros(0, np.int64)
        keep = ids != -2  # signs alone are no words
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids, codes = ids[keep], codes[keep]
        step = max(32, index.longest)
        counts = np.maximum(-(-(np.diff(offsets) - step) // step), np.diff(offsets) > 0)  # windows of 2 * step words; one for a short text
        row_of = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        start = offsets[:-1][row_of] + (np.arange(len(row_of)) - first[row_of]) * step
        stop = np.minimum(start + 2 * step, offsets[1:][row_of])
        # Sum of the best impacts of the distinct terms of each window: a word counts where it did not occur before in the
        # window. A word lies in the window that starts with its half and in the one before.
        at = np.flatnonzero(ids >= 0)
        at = at[np.argsort(ids[at], kind="stable")]
        before = np.full(len(at), -1)
        same = ids[at[1:]] == ids[at[:-1]]
        before[1:][same] = at[:-1][same]
        row = np.searchsorted(offsets, at, "right") - 1
        half = (at - offsets[row]) // step
        total = np.zeros(len(row_of))
        for back in (0, 1):
            begins = offsets[row] + (half - back) * step
            inside = (half >= back) & (half - back < counts[row]) & (before < begins)
            total += np.bincount((first[row] + half - back)[inside], index.bound[ids[at[inside]]], minlength=len(row_of))
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for w in np.flatnonzero(total >= self.threshold - 1e-9):
            distinct = np.unique(ids[start[w] : stop[w]])
            distinct = distinct[distinct >= 0]
            self.bounded += 1
            if index.range_max[distinct].sum(axis=0).max() < self.threshold - 1e-4:
                continue
            self.searched += 1
            got = index.retrieve(distinct.tolist(), self.threshold)
            if got:
                words = [terms[c][0] for c in codes[start[w] : stop[w]]]
                by_size = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, SHINGLE + 1)}
                for item, score in got:
                    (q, a) = index.parts[item]
                    in_q, in_a = (sum(s in by_size[len(s)] for s in part) for part in (q, a))
                    both, qo, ao = (in_q + in_a) / (len(q) + len(a)), in_q / len(q), in_a / len(a) if a else 1.0
                    if both >= OVERLAP and qo >= LEAST_PART and ao >= LEAST_PART:
                        key = int(row_of[w]), item
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0, 0.0)), (both, score, qo, ao))
        return [(r, i, s, q, a) for (r, i), (_, s, q, a) in sorted(best.items())]


def _indexes(items: DataFrame) -> Iterator[Index]:
    """One index after another. The items pass the driver one partition at a time; it holds a block of them and the terms' counts."""
    chosen = items.select("item_id", "text")
    statistics = Statistics(r["text"] for r in chosen.toLocalIterator())
    block, words = [], 0
    for r in chosen.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        words += len((r["text"] or "").split())
        if len(block) >= ITEM_BLOCK or words >= BLOCK_WORDS:
            yield Index(block, statistics)
            block, words = [], 0
    if block:
        yield Index(block, statistics)


def find_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document that holds a test item."""
    spark = documents.sparkSession
    types = {"doc_id": documents.schema["doc_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    schema = f"doc_id {types['doc_id']}, item_id {types['item_id']}, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _indexes(items):
        if not index.keys:
            continue
        shared = spark.sparkContext.broadcast(index)  # ITEM_BLOCK items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for b in common.pieces(batches, LETTERS):
                hits = matcher.hits(common.column(b, "text"))
                docs = common.column(b, "doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                keys = [matcher.index.keys[h[1]] for h in hits]
                yield pa.RecordBatch.from_arrays([docs, pa.array(keys), *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))] if hits else [docs, pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = documents.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that hold no test item, with all their columns."""
    for index in _indexes(items):
        if not index.keys:
            continue
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for b in common.pieces(batches, LETTERS):
                bad = {h[0] for h in matcher.hits(common.column(b, "text"))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        documents = documents.mapInArrow(run, documents.schema)
    return documents

"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample gives the longest match from any place of a text, so a text falls into
phrases, each the longest that the sample contains. The language whose sample needs the fewest bits for them
(phrases * log2(sample length) / letters) wins; of equal ones, the first by name.

Texts are read as UTF-8, lower and upper case as one, runs of anything but letters as one space; bytes let every script have
its own codes. Whole texts are parsed: blocks of a text are parsed side by side from the automaton's root first, and then again from
where the block before ended, until both parses are in the same state, which makes the phrases those of one pass.

Null texts, empty ones and those without a letter are `und` with score 0. The score is 1 - bits of the best language /
bits of the second (1 if only one language is known). Very long texts are parsed whole. Repeated rows get equal results; a
repeated doc_id is learned from once; extra columns are ignored, whatever their names; an empty table, or one without a
labelled row, gives `und` for every row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents chosen per language to learn from, those of up to LONG_DOC bytes first, and bytes at which a language's sample ends.
SAMPLE_DOCS, SAMPLE_BYTES, LONG_DOC = 200, 60_000, 6_000
#: A text that needs more than BITS_FACTOR times the median bits of labelled texts outside the sample is in no learned
#: language; NO_BITS holds where there are fewer than FEW such texts.
BITS_FACTOR, NO_BITS, FEW = 2.0, 9.0, 5
#: Bytes in a block, blocks parsed at once, and what pads a block.
BLOCK, STEP, PAD = 1024, 2048, 256
#: Bytes of text that a Python worker parses at a time (one text at least).
LETTERS = 2_000_000
_MISS = 1 << 30


@dataclass
class Model:
    """Sample of each language, normalised; the automata are built from it once in each Python worker."""

    samples: dict[str, bytes]
    key: str
    #: Bits a letter that texts of a language need at most, as learned.
    most_bits: dict[str, float] = field(default_factory=dict)


_fold: np.ndarray | None = None


def _folded() -> np.ndarray:
    """Code point of each code point: its lower case, or a space for what is no letter."""
    global _fold
    if _fold is None:
        _fold = np.fromiter(((ord(low) if len(low := chr(i).lower()) == 1 and low.isalpha() else i) if chr(i).isalpha() else 32 for i in range(0x110000)), "<u4", 0x110000)
    return _fold


def normalised(text: str) -> tuple[bytes, int]:
    """Lower-case letters and single spaces, as UTF-8, and the number of letters."""
    x = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return x[keep].tobytes().decode("utf-32-le").encode(), int(len(x) - space.sum())


def suffix_automaton(seq: list[int], width: int) -> np.ndarray:
    """Transitions [state, code] of the automaton of all substrings; where there is none, the root's with _MISS set (the root itself if it has none). The last code pads: it keeps the state."""
    link, length, nexts, last = [-1], [0], [{}], 0
    for c in seq:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        nexts.append({})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.full(width, _MISS, np.int32)
    for c, s in nexts[0].items():
        root[c] = s | _MISS
    out = np.tile(root, (len(link), 1))
    for s, d in enumerate(nexts):
        for c, t in d.items():
            out[s, c] = t
    out[:, width - 1] = np.arange(len(link))
    return out.reshape(-1)


def byte_codes(sample: bytes) -> tuple[np.ndarray, int]:
    """Code of each byte and of the padding: those of the sample in order, then one for all others, which matches nothing; the number of codes."""
    seen = np.unique(np.frombuffer(sample, np.uint8))
    table = np.full(PAD + 1, len(seen), np.int32)
    table[seen] = np.arange(len(seen))
    table[PAD] = len(seen) + 1
    return table, len(seen) + 2


def _build(model: Model):
    out = []
    for lang in sorted(model.samples):
        sample = model.samples[lang]
        table, width = byte_codes(sample)
        out.append((lang, table, width, suffix_automaton(table[np.frombuffer(sample, np.uint8)].tolist(), width), float(np.log2(max(len(sample), 2)))))
    return out


def _automata(model: Model):
    return common.made(("langid", model.key), lambda: _build(model))


class Blocks:
    """Texts cut into blocks, those of like length together: (numbers of blocks, bytes by place and block), and for each
    block its text, the block before it and the one after it (-1 if none)."""

    def __init__(self, texts: list[bytes]):
        cut, text, before = [], [], []
        for i, t in enumerate(texts):
            x = np.frombuffer(t, np.uint8)
            for a in range(0, len(x), BLOCK):
                before.append(len(cut) - 1 if a else -1)
                text.append(i)
                cut.append(x[a : a + BLOCK])
        self.text, self.before = np.array(text, np.int64), np.array(before, np.int64)
        self.after = np.full(len(cut), -1, np.int64)
        held = np.flatnonzero(self.before >= 0)
        self.after[self.before[held]] = held
        order = np.argsort([-len(c) for c in cut], kind="stable")
        self.parts = []
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            m = np.full((len(cut[some[0]]), len(some)), PAD, np.uint16)
            for j, k in enumerate(some):
                m[: len(cut[k]), j] = cut[k]
            self.parts.append((some, m))


def phrases(blocks: Blocks, automaton: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Phrases that end in each block, the last one of a text not counted."""
    n, mask = len(blocks.text), _MISS - 1
    from_root, count, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
    traces = []
    for ids, m in blocks.parts:
        codes, state = table[m], np.zeros(len(ids), np.int32)
        trace = np.empty(m.shape, np.int32)
        for t, row in enumerate(codes):
            trace[t] = automaton[state * width + row]
            state = trace[t] & mask
        from_root[ids] = count[ids] = (trace >> 30).sum(axis=0)
        last[ids] = state
        traces.append((ids, codes, trace))
    root_last = last.copy()
    pending = blocks.before >= 0
    while pending.any():  # once, but for blocks in which the two parses never meet
        was = last.copy()
        for ids, codes, trace in traces:
            col = np.flatnonzero(pending[ids])
            state = was[blocks.before[ids[col]]]
            more = np.zeros(len(col), np.int64)
            count[ids[col]], last[ids[col]] = from_root[ids[col]], root_last[ids[col]]
            open_ = state != 0
            col, state, more = col[open_], state[open_], more[open_]
            for t in range(len(codes)):
                if not len(col):
                    break
                v, plain = automaton[state * width + codes[t, col]], trace[t, col]
                more += (v >> 30) - (plain >> 30)
                state = v & mask
                met = state == (plain & mask)
                if met.any():
                    count[ids[col[met]]] += more[met]
                    col, state, more = col[~met], state[~met], more[~met]
            count[ids[col]] += more
            last[ids[col]] = state
        changed = np.flatnonzero((last != was) & (blocks.after >= 0))
        pending = np.zeros(n, bool)
        pending[blocks.after[changed]] = True
    return count


def fit(documents: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """Learn from text and lang of the rows outside the held-out fold: a bounded sample per language (its last text is cut at SAMPLE_BYTES)."""
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(F.col("size") > LONG_DOC, F.xxhash64("doc_id"), "doc_id")
    labelled = documents.select("doc_id", "lang", size.alias("size"), "text").filter(F.col("lang").isNotNull() & (F.col("size") > 0) & (common.fold("doc_id", folds) != held_out))
    ids = labelled.select("doc_id", "lang", "size").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_DOCS)
    sum_before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ids.withColumn("before", sum_before).filter(F.col("before") < 2 * SAMPLE_BYTES).groupBy("lang", "doc_id").agg(F.min("rank").alias("rank"))
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "rank").agg(F.min(F.substring("text", 1, SAMPLE_BYTES)).alias("text")).collect()  # SAMPLE_DOCS rows and about 3 * SAMPLE_BYTES letters a language at most
    samples: dict[str, bytes] = {}
    others: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        text, letters = normalised(r["text"])
        if letters and len(samples.get(r["lang"], b"")) < SAMPLE_BYTES:
            samples[r["lang"]] = (samples.get(r["lang"], b"") + b" " + text)[:SAMPLE_BYTES]
        elif letters:
            others.setdefault(r["lang"], []).append(r["text"])
    model = Model(samples, hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest())
    for lang in samples:
        bits = predict_texts(others.get(lang, []), Model({lang: samples[lang]}, f"{model.key}/{lang}"))[2]
        model.most_bits[lang] = BITS_FACTOR * float(np.median(bits)) if len(bits) >= FEW else NO_BITS
    return model


def predict_texts(texts: list[str], model: Model) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits of each text: those of the best language per letter, after the first phrase, which every text has."""
    both = [normalised(t) for t in texts]
    letters = np.array([n for _, n in both], np.int64)
    blocks = Blocks([t if n else b"" for t, n in both])
    automata = _automata(model)
    if not automata or not len(blocks.text):
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    bits = np.array([(np.bincount(blocks.text, phrases(blocks, automaton, table, width), minlength=len(texts)) + 1) * size for _, table, width, automaton, size in automata])
    bits /= np.maximum(letters, 1)
    best = bits.argmin(axis=0)
    low = bits.min(axis=0)
    second = np.partition(bits, 1, axis=0)[1] if len(automata) > 1 else np.full(len(texts), np.inf)
    score = np.where(letters > 0, 1 - low / np.maximum(second, 1e-12), 0.0).clip(0, 1)
    after = low - np.array([a[4] for a in automata])[best] / np.maximum(letters, 1)
    return [automata[b][0] if n else "und" for b, n in zip(best, letters)], score.tolist(), np.where(letters > 0, after, 0.0).tolist()


def _predict(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches, LETTERS, keep_made=True):
        lang, score, bits = predict_texts(common.text_list(b), model)
        yield pa.RecordBatch.from_arrays([common.column(b, c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], keep + names)


def predict(documents: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """Columns `keep`, then language, score and bits (per letter) under the given names."""
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double"))])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # SAMPLE_BYTES per language
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: _predict(it, shared.value, keep, list(names)), schema)

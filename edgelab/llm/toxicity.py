"""Toxicity: noisy-channel restoration of disguised words, then a classifier of the restored text.

A word with digits or signs in it, with letters three times in a row, or a run of short tokens, as in words spelled with
spaces between their letters, is a lattice: each character stands for itself or the letters it imitates, what is not a
letter may vanish or end a word, runs may shrink. A Viterbi search under a character trigram model finds the likeliest
reading, and the likeliest one in which whatever can imitate a letter does, unless the token is a number. Any other word
has one path only, itself, and is taken as it is. A logistic model over words and word beginnings of the restored text
gives the score.

Null and empty texts are scored by the intercept alone; very long texts are read whole, in learning too. Labels are read as
the largest per doc_id where a document has several; of texts that share a doc_id the one with the least features is
learned from; equal texts get equal scores, and features that tie are taken by name. Extra columns are ignored, whatever
their names; an empty table gives an empty result; without labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters that the character model tells apart, the most frequent of the texts; all others share one code. Bounds its table.
ALPHABET = 100
#: Labelled documents to learn from, at most, of each label.
SAMPLE_ROWS = 3_000
#: A feature is used from this log-likelihood ratio on; at most so many are looked at, the best first, and so many used: the size of the classifier.
LEAST_G2, CANDIDATES, MOST_FEATURES = 25.0, 20_000, 2_000
#: Features that explain a toxic text well enough, so that further ones must help elsewhere.
COVER = 4
#: Characters as imitations of letters (fixed values).
IMITATIONS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
# Log costs of the channel: imitation, vanished separator, shortened run.
IMITATE, VANISH, SHRINK = -1.0, -0.7, -0.5
LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(c for c in IMITATIONS if not c.isalnum())
_KEPT = re.escape(_SIGNS)
#: Signs at the ends of a token that imitate no letter.
_EDGES = re.compile(rf"^[^\w{_KEPT}]+|[^\w{_KEPT}]+$")
#: A run of tokens of at most SHORT characters between such signs is one lattice if so many are of one character.
SHORT, LEAST_SINGLE = 2, 3
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Tokens whose features a Python worker keeps at most.
CACHE_WORDS = 300_000


class CharModel:
    """Character trigrams with add-k smoothing over the letters seen and a word edge."""

    def __init__(self, words: Counter):
        """Counted from words with their numbers; see `char_model` for those of a table."""
        seen = Counter()
        for w, n in words.items():
            for c in w:
                seen[c] += n
        alphabet = "".join(c for c, _ in seen.most_common(ALPHABET))
        codes, size = np.zeros(0x110000, np.uint8), len(alphabet) + 2
        for c in seen:
            codes[ord(c)] = alphabet.find(c) + 1 or size - 1
        counts = np.zeros(size**3)
        for w, n in words.items():
            np.add.at(counts, trigrams(np.array([*map(ord, w), 32]), codes, size), n)
        self._set(alphabet, counts)

    @classmethod
    def of(cls, alphabet: str, counts: np.ndarray) -> CharModel:
        """alphabet: letters by code from 1; counts: of trigrams of codes, 0 the edge, the last any other letter."""
        model = cls.__new__(cls)
        model._set(alphabet, counts)
        return model

    def _set(self, alphabet: str, counts: np.ndarray) -> None:
        self.code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.other = len(alphabet) + 1
        counts = counts.reshape((self.other + 1,) * 3) + 0.05
        self.log = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)

    def restore(self, token: str, imitated: bool = False) -> str:
        """The likeliest reading of lower-case tokens with spaces between them: letters, and a space between words.

        imitated: whatever can imitate a letter does."""
        runs = []
        for c in token:  # runs of three or more equal letters may stand for one or two
            if runs and c == runs[-1][0]:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        log, size, code, other = self.log.item, self.other + 1, self.code, self.other
        paths = {(0, 0): (0.0, None)}  # by the last two codes: score, and (what came before, letters)
        for c, n in runs:
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c * min(n, 2), 0.0) if n < 3 else (c * 2, SHRINK))
                if n >= 3:
                    options.append((c, SHRINK))
            if c in IMITATIONS:
                options += [(x * min(n, 2), IMITATE * n) for x in IMITATIONS[c]]
                if n >= 3:
                    options += [(x, IMITATE * n) for x in IMITATIONS[c]]
            if not c.isalpha() and not (imitated and c in IMITATIONS):
                options += [("", VANISH * n), (" ", 0.0 if c == " " else VANISH)]
            coded = [(letters, [code.get(d, other) if d != " " else 0 for d in letters], cost) for letters, cost in options]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, text) in paths.items():
                for letters, codes, cost in coded:
                    x, y, s = a, b, score + cost
                    for z in codes:
                        if z:
                            s += log((x * size + y) * size + z)
                            x, y = y, z
                        elif y:  # the word ends
                            s += log((x * size + y) * size)
                            x, y = 0, 0
                    old = new.get((x, y))
                    if old is None or s > old[0]:
                        new[x, y] = s, (text, letters) if letters else text
            paths = new
        text = max(((s + (log((a * size + b) * size) if b else 0.0), k) for k, ((a, b), (s, _)) in enumerate(paths.items())))[1]
        at, out = [t for _, t in paths.values()][text], []
        while at is not None:
            at, letters = at
            out.append(letters)
        return " ".join("".join(reversed(out)).split())


def _letters() -> np.ndarray:
    """For each code point whether LETTERS takes it."""
    found = np.zeros(0x110000, bool)
    for m in LETTERS.finditer("".join(map(chr, range(0x110000)))):
        found[m.start() : m.end()] = True
    return found


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Code points of the lower-case texts, a space after each text."""
    for b in common.pieces(batches, keep_made=True):
        text = " ".join([*common.text_list(b), ""]).lower()
        yield np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, total = common.made("toxicity-letters", _letters), np.zeros(0x110000, np.int64)
    for points in _points(batches):
        found = np.bincount(points)
        total[: len(found)] += found
    at = np.flatnonzero(total * letters)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])


def trigrams(points: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    """Numbers (a * size + b) * size + c of the trigrams of all words, each with its edges before and after; codes: by code point, 0 no letter."""
    c = codes[points].astype(np.int32)
    b = np.concatenate([[0], c[:-1]]).astype(np.int32)
    a = np.where(b > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)], 0).astype(np.int32)
    return ((a * size + b) * size + c)[(b > 0) | (c > 0)]


def _count_trigrams(batches: Iterator[pa.RecordBatch], codes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size**3, np.int64)
    for points in _points(batches):
        total += np.bincount(trigrams(points, codes, size), minlength=size**3)
    at = np.flatnonzero(total)
    for k in range(0, len(at), 100_000):
        x = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(total[x], pa.int64())], ["at", "n"])


def char_model(documents: DataFrame) -> CharModel:
    """Counted from every word of every text; each task counts its texts first, and at most (ALPHABET + 2)^3 sums come to the driver."""
    texts, spark = documents.select("text"), documents.sparkSession

    def sums(counted: DataFrame) -> DataFrame:
        return counted.groupBy("at").agg(F.sum("n").alias("n"))

    top = sums(texts.mapInArrow(_count_letters, "at long, n long")).orderBy(F.desc("n"), "at").limit(ALPHABET).collect()
    alphabet = "".join(chr(r["at"]) for r in top)
    size, codes = len(alphabet) + 2, np.where(_letters(), len(alphabet) + 1, 0).astype(np.uint8)
    for i, c in enumerate(alphabet):
        codes[ord(c)] = i + 1
    shared = spark.sparkContext.broadcast(codes)  # a byte for each code point
    counts = np.zeros(size**3)
    found = sums(texts.mapInArrow(lambda it: _count_trigrams(it, shared.value, size), "at long, n long")).toArrow()
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return CharModel.of(alphabet, counts)


def token_words(token: str, chars: CharModel | None) -> list[str]:
    """Words of a token, or of tokens spelled with spaces: its runs of letters and, where it may be a disguise, its likeliest reading."""
    low = token.lower()
    if low.isalpha() and not _THRICE.search(low):
        return [low]
    words = LETTERS.findall(low)
    core = _EDGES.sub("", low)
    if chars is not None and len(core) > 1 and (not core.isalpha() or _THRICE.search(core)):
        words += chars.restore(core).split()
        if any(c in IMITATIONS for c in core) and any(c.isalpha() or c in _SIGNS for c in core):
            words += chars.restore(core, imitated=True).split()
    return words


def core_size(token: str) -> int:
    """Characters between signs at the ends that imitate no letter."""
    return len(_EDGES.sub("", token)) if len(token) <= 4 * SHORT else SHORT + 1


def spelled(tokens: list[str], between: str = "") -> list[str]:
    """Runs of tokens of at most SHORT characters with LEAST_SINGLE of one character, joined."""
    out, run, single = [], [], 0
    for t in [*tokens, "x" * (SHORT + 1)]:
        size = core_size(t)
        if size <= SHORT:
            run.append(t)
            single += size == 1
        else:
            if single >= LEAST_SINGLE:
                out.append(between.join(run))
            run, single = [], 0
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


@dataclass
class Model:
    chars: CharModel | None
    weights: dict[str, float]
    bias: float


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(batches: Iterator[pa.RecordBatch], chars: CharModel) -> Iterator[pa.RecordBatch]:
    """The features of each text, in order."""
    memo: dict[str, list[str]] = {}
    for b in common.pieces(batches):
        out = []
        for text in common.text_list(b):
            tokens, found = text.split(), set()
            for t in {*tokens, *spelled(tokens, " ")}:
                if t not in memo:
                    if len(memo) > CACHE_WORDS:
                        memo.clear()
                    memo[t] = [f for w in token_words(t, chars) for f in features(w)]
                found.update(memo[t])
            out.append(sorted(found))
        yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), common.column(b, "toxic"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])


def _numbered(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(number[f] for f in fs if f in number) for fs in common.column(b, "features").to_pylist()]
        yield pa.RecordBatch.from_arrays([common.column(b, "toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])


def fit(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    spark = documents.sparkSession
    with common.scratch(spark):
        known = labels.filter(F.col("toxic").isNotNull() & (common.fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        picked = common.sample_ids(known.filter("toxic = 1"), SAMPLE_ROWS).unionByName(common.sample_ids(known.filter("toxic = 0"), SAMPLE_ROWS))
        share = known.agg(F.avg("toxic")).first()[0]
        chosen = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
        n = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
        n0, n1 = n.get(0, 0), n.get(1, 0)
        if not n0 or not n1:
            return Model(None, {}, 50.0 if n1 and share == 1 else -50.0)
        chars = char_model(documents.filter(F.coalesce(common.fold("doc_id", folds) != held_out, F.lit(True))))
        shared = spark.sparkContext.broadcast(chars)  # (ALPHABET + 2)^3 numbers
        kind = documents.schema["doc_id"].dataType.simpleString()
        found = chosen.mapInArrow(lambda it: _features(it, shared.value), f"doc_id {kind}, toxic int, features array<string>")
        rows = common.materialise(found.groupBy("doc_id", "toxic").agg(F.min("features").alias("features")), "toxic-features")
        ranked = _ranked(rows, n0, n1)
        number = {f: i for i, f in enumerate(ranked)}
        table = rows.mapInArrow(lambda it: _numbered(it, number), "toxic int, found array<int>").toArrow()
    return _train(table.column("toxic").to_numpy().astype(float), table.column("found").to_pylist(), ranked, chars, share)


def _ranked(rows: DataFrame, n0: int, n1: int) -> list[str]:
    """Features of toxic texts by their log-likelihood ratio, the best first."""
    k, j = F.col("k"), F.col("j")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    p = (k + j) / (n0 + n1)
    g2 = 2 * (part(k, n1 * p) + part(j, n0 * p) + part(n1 - k, n1 * (1 - p)) + part(n0 - j, n0 * (1 - p)))
    counted = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("j"))
    good = counted.filter((k >= 4) & (k * n0 > 2 * j * n1)).withColumn("g2", g2).filter(F.col("g2") >= LEAST_G2)
    return [r["feature"] for r in good.orderBy(F.desc("g2"), "feature").limit(CANDIDATES).select("feature").collect()]


def _train(y: np.ndarray, found: list[list[int]], ranked: list[str], chars: CharModel, share: float) -> Model:
    """Words that only accompany others, as in copies of one text, explain nothing new: a feature must add to toxic texts that
    have fewer than COVER features so far."""
    n1, n0 = y.sum(), len(y) - y.sum()
    having: list[list[int]] = [[] for _ in ranked]
    for i, fs in enumerate(found):
        if y[i]:
            for f in fs:
                having[f].append(i)
    covered, chosen = np.zeros(len(y)), {}
    same: set[tuple[int, ...]] = set()
    for f, texts in enumerate(having):
        if tuple(texts) in same:  # a word and its own beginnings, in the same texts
            continue
        if (covered[texts] < COVER).sum() >= max(1, min(4, n1 // 100)) and len(chosen) < MOST_FEATURES:
            chosen[f] = len(chosen)
            same.add(tuple(texts))
            covered[texts] += 1
    x = np.zeros((len(y), len(chosen)))
    for i, fs in enumerate(found):
        x[i, [chosen[f] for f in fs if f in chosen]] = 1
    w = logistic(x, y)
    prior = np.log(share / (1 - share)) - np.log(n1 / n0)  # the sample holds more of the rare label than the rows
    return Model(chars, {ranked[f]: float(w[i]) for f, i in chosen.items()}, float(w[-1] + prior))


class Scorer:
    """Looks at each distinct token of a batch once; Arrow finds them."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.index = {f: i for i, f in enumerate(sorted(model.weights))}
        self.weights = np.array([model.weights[f] for f in sorted(model.weights)])

    def token(self, token: str) -> tuple[int, ...]:
        """Features of a token, as numbers."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > CACHE_WORDS:
                self.memo.clear()
            got = self.memo[token] = tuple({self.index[f] for w in token_words(token, self.model.chars) for f in features(w) if f in self.index})
        return got

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = rows.flatten().dictionary_encode()
        offsets = rows.offsets.to_numpy().astype(np.int64) - rows.offsets[0].as_py()
        index = coded.indices.to_numpy(zero_copy_only=False)
        tokens = common.strings(coded.dictionary)
        sizes = np.fromiter(map(core_size, tokens), np.int64, len(tokens))
        found = [self.token(t) for t in tokens]
        has = np.fromiter((bool(f) for f in found), bool, len(tokens))
        at = np.flatnonzero(has[index])
        hits = {(int(d), f) for d, t in zip(np.searchsorted(offsets, at, "right") - 1, index[at]) for f in found[t]}
        size = sizes[index]
        short, doc = size <= SHORT, np.repeat(np.arange(len(texts)), np.diff(offsets))
        first = short & np.concatenate([[True], ~short[:-1] | (doc[1:] != doc[:-1])])[: len(short)]
        starts = np.flatnonzero(first)
        if len(starts):
            held, alone = np.diff([*np.flatnonzero(first[short]), short.sum()]), np.add.reduceat((size == 1)[short], np.flatnonzero(first[short]), dtype=np.int64)
            for at, n in zip(starts[alone >= LEAST_SINGLE].tolist(), held[alone >= LEAST_SINGLE].tolist()):
                hits.update((int(doc[at]), f) for f in self.token(" ".join([tokens[i] for i in index[at : at + n]])))
        z = np.full(len(texts), self.model.bias)
        if hits:
            docs, feats = np.array(sorted(hits)).T
            z += np.bincount(docs, self.weights[feats], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in common.pieces(batches):
        yield pa.RecordBatch.from_arrays([common.column(b, c) for c in keep] + [pa.array(scorer.scores(common.column(b, "text")), pa.float64())], keep + [name])


def score(documents: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns `keep`, then the score under the given name."""
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` double"])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights and (ALPHABET + 2)^3 trigrams
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: _score(it, shared.value, keep, name), schema)

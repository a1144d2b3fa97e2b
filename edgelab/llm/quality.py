"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a logistic model of style: it minimises the non-negative
unbiased risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)), whose class prior pi is estimated first, as the least ratio of
unlabelled to positive texts above a threshold of a plain positive-against-unlabelled model, on texts that model has not seen.

Features are the shares of pairs of neighbouring character classes over the whole text, and how often words, word pairs
and lines repeat. Null and empty texts have all features 0; very long texts are read whole, in learning too. Labels are read
as the largest per doc_id; of texts that share a doc_id the one with the least features is learned from; equal texts get
equal scores. Extra columns are ignored, whatever their names; an empty table gives an empty result; without positives
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts to learn from, at most: positives, unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 8_000
CLASSES = 20
FEATURES = CLASSES * CLASSES + 5
#: Columns standardised at a time.
COLUMNS = 27
_SIGNS = ".,!?;:|%$&*#'\"-"
_table: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: 0 other sign, 1 lower case, 2 upper case, 3 digit, 4 white space, then single signs."""
    global _table
    if _table is None:
        t = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                t[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                t[i] = 3
            elif c.isspace():
                t[i] = 4
        for k, c in enumerate(_SIGNS):
            t[ord(c)] = 5 + k
        _table = t
    return _table


def style(text: str) -> np.ndarray:
    """Features of one whole text."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    x = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int16)
    pairs = np.bincount(x[:-1] * CLASSES + x[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(len(x) - 1, 1))
    words = text.split()
    n = len(words)
    if n > 1:
        out[-5] = np.sqrt(sum(map(str.__eq__, words, words[1:])) / (n - 1))
        out[-4] = 1 - len(set(zip(words, words[1:]))) / (n - 1)
        lines = text.split("\n")
        out[-3] = 1 - len(set(lines)) / len(lines)
    out[-2] = np.log1p(n) / 10
    out[-1] = np.log1p(len(text) / max(n, 1)) / 5
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, width: int, steps: int, rate: float = 0.02) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Least ratio of the shares of unlabelled and positive scores above a threshold, with a margin for small counts."""
    cuts = np.unique(np.quantile(pos, np.linspace(0.0, 0.9, 60)))
    above_p = np.array([(pos >= c).mean() for c in cuts])
    above_u = np.array([(unl >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(100) / 2) * (1 / np.sqrt(len(unl)) + above_u / np.maximum(above_p, 1e-9) / np.sqrt(len(pos)))
    bound = (above_u + margin) / np.maximum(above_p, 1e-9)
    return float(np.clip(above_u[bound.argmin()] / above_p[bound.argmin()], 0.05, 0.98))


def standardised(pos: np.ndarray, unl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both tables as one of double precision, standardised, with a last column of ones; means and scales. It is changed in
    place, some columns at a time, so that the driver holds it once."""
    n, width = len(pos), pos.shape[1]
    both, mean, scale = np.ones((n + len(unl), width + 1)), np.empty(width), np.empty(width)
    both[:n, :-1], both[n:, :-1] = pos, unl
    for a in range(0, width, COLUMNS):
        z = min(a + COLUMNS, width)
        x = both[:, a:z]
        mean[a:z] = x.mean(axis=0)
        scale[a:z] = x.std(axis=0) + 0.02
        x -= mean[a:z]
        x /= scale[a:z]
    return both, mean, scale


def train(pos: np.ndarray, unl: np.ndarray, steps: int = 400, ridge: float = 1e-3) -> Model:
    """Non-negative unbiased risk with the logistic loss, by full gradients."""
    both, mean, scale = standardised(pos, unl)
    p, u = both[: len(pos)], both[len(pos) :]
    width = p.shape[1]

    def plain(w, a, b):
        return -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + ridge * w

    w = _adam(lambda w: plain(w, p[::2], u[::2]), width, steps // 2)
    prior = class_prior(p[1::2] @ w, u[1::2] @ w)

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.log1p(np.exp(np.clip(u @ w, -40, 40))).mean() - prior * np.log1p(np.exp(np.clip(p @ w, -40, 40))).mean()
        rest = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative < 0:  # the part that cannot be negative went below 0: step back along it
            return -rest + ridge * w
        return -prior * (p.T @ (1 - sp)) / len(p) + rest + ridge * w

    return Model(mean, scale, _adam(gradient, width, steps), prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches):
        rows = [style(t).tobytes() for t in common.text_list(b)]
        yield pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(rows, pa.binary())], ["doc_id", "x"])


def _fetch(documents: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the chosen documents, one row for each id; ids holds a bounded number of rows."""
    some = documents.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    one = some.mapInArrow(_features, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = sorted((r["doc_id"], bytes(r["x"])) for r in one.collect())
    return np.frombuffer(b"".join(x for _, x in rows), np.float32).reshape(-1, FEATURES)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    positive = labels.filter(F.col("quality").isNotNull() & (common.fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1")
    unlabelled = documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    pos, unl = _fetch(documents, common.sample_ids(positive, POSITIVES)), _fetch(documents, common.sample_ids(unlabelled, UNLABELLED))
    if len(pos) < 4 or len(unl) < 4:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    return train(pos, unl)


def _score(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    for b in common.pieces(batches):
        x = np.array([style(t) for t in common.text_list(b)])
        yield pa.RecordBatch.from_arrays([common.column(b, c) for c in keep] + [pa.array(model.score(x), pa.float64())], keep + [name])


def score(documents: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns `keep`, then the score under the given name."""
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` double"])
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: _score(it, model, keep, name), schema)

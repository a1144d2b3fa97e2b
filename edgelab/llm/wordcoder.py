"""Ids of texts from ids of their distinct words: Arrow finds the distinct words of a batch, Python sees each once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Words whose ids a Python worker keeps, and a batch's more; then it starts anew. Bounds memory at about 200 MB a worker.
CACHE_WORDS = 1_200_000


class WordCoder:
    """encode_new gives the ids of words not seen before: all ids in one array, and where each word's begin in it and how many they are."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], mark: str, first_mark: str, most_words: int = CACHE_WORDS):
        self.encode_new, self.marks, self.most_words = encode_new, (mark, first_mark), most_words
        self.clear()

    def clear(self) -> None:
        """Forget all words: `words` and `firsts` number them, the arrays hold their ids one after another."""
        self.words, self.firsts = {}, {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.count = 0

    def _slots(self, known: dict[str, int], words: list[str], mark: str) -> np.ndarray:
        slots = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            flat, starts, sizes = self.encode_new([mark + w for w in new] if mark else new)
            n, m = self.count + len(new), self.used + len(flat)
            while n > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            while m > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : m], self.starts[self.count : n], self.sizes[self.count : n] = flat, self.used + starts, sizes
            known.update(zip(new, range(self.count, n)))
            self.used, self.count = m, n
            slots[missing] = [known[words[i]] for i in missing.tolist()]
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it. Each text is cut at single spaces."""
        if self.count > self.most_words:
            self.clear()
        rows = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = rows.flatten().dictionary_encode()
        starts = rows.offsets.to_numpy().astype(np.int64) - rows.offsets[0].as_py()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = common.strings(coded.dictionary)
        slot = self._slots(self.words, words, self.marks[0])[index]
        if self.marks[0] != self.marks[1]:
            at = starts[:-1]
            slot[at] = self._slots(self.firsts, [words[i] for i in index[at].tolist()], self.marks[1])
        count = self.sizes[slot]
        ends = np.cumsum(count, dtype=np.int64)
        take = np.repeat(self.starts[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[take], np.concatenate([[0], ends])[starts]

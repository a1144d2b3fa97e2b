"""SentencePiece encoding by a Viterbi search that distinct words share along common prefixes, and decoding.

A text is cut before each space; a word carries the space as the mark U+2581. Distinct words are sorted, which lists a
trie depth-first, and the forward scores of a common prefix are kept from one word to the next. A character that no piece
has becomes its UTF-8 bytes. The best path has the highest sum of piece scores; where the file's scores are merge ranks, which
are no likelihoods, it is the one of fewest pieces, and of those the one with the highest sum. Of equal paths, the one whose
last piece starts earliest wins.

Nulls: a null text encodes as an empty one (no ids; decodes to an empty text). Literal U+2581 becomes bytes, so decoding
restores every text exactly. Very long texts and very long words are encoded whole; repeated texts get equal ids. Extra
columns are ignored by the operator, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .wordcoder import WordCoder

MARK = "▁"
#: Score of one byte piece; below any sum of ordinary pieces over a word's characters.
BYTE_SCORE = -(1 << 60)
#: Added to each piece's score where scores are merge ranks: beyond any sum of ranks in a word of a million pieces.
PIECE_SCORE = -(1 << 36)
#: Bytes of text that a Python worker encodes at a time (one text at least).
LETTERS = 1_000_000
#: Words whose ids a Python worker keeps at most.
CACHE_WORDS = 300_000


class PieceTable:
    """Pieces and scores of a public model file."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        self.byte_ids = byte_ids
        self.surface = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        skip = set(byte_ids) | {i for i, p in enumerate(pieces) if p in ("<unk>", "<s>", "</s>", "<pad>") or MARK in p[1:]}
        self.ids = {p: (scores[i], i) for i, p in enumerate(pieces) if i not in skip and p}
        own = sorted(s for s, _ in self.ids.values())
        if own and all(s == int(s) <= 0 for s in own) and len(set(own)) == len(own):  # merge ranks
            self.ids = {p: (int(s) + PIECE_SCORE, i) for p, (s, i) in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        # The longest piece that ends in a character: fewer lookups per position.
        self.ending: dict[str, int] = {}
        for p in self.ids:
            self.ending[p[-1]] = max(self.ending.get(p[-1], 0), len(p))

    @classmethod
    def load(cls, path: str) -> "PieceTable":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        return cls(pieces, [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def shared_prefix_viterbi(words: Iterable[str], table: PieceTable) -> Iterator[tuple[str, list[int]]]:
    """Best pieces of each distinct word (without its mark), in sorted order."""
    ids, ending, byte_ids = table.ids, table.ending, table.byte_ids
    before = ""
    score, back, piece = [0], [0], [-1]  # by length of the prefix; the mark has length 1
    for word in sorted(set(words)):
        chars = MARK + word.replace(MARK, "\0")  # a literal mark matches no piece
        common_len = 0
        for a, z in zip(before, chars):
            if a != z:
                break
            common_len += 1
        del score[common_len + 1 :], back[common_len + 1 :], piece[common_len + 1 :]
        for end in range(common_len + 1, len(chars) + 1):
            c = chars[end - 1]
            best, at, which = None, end - 1, -1
            for start in range(max(0, end - ending.get(c, 0)), end):
                found = ids.get(chars[start:end])
                if found is not None:
                    s = score[start] + found[0]
                    if best is None or s > best:
                        best, at, which = s, start, found[1]
            if best is None:
                best = score[end - 1] + BYTE_SCORE * len((MARK if c == "\0" else c).encode("utf-8", "surrogatepass"))
            score.append(best)
            back.append(at)
            piece.append(which)
        before = chars
        out, end, original = [], len(chars), MARK + word
        while end:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend(byte_ids[b] for b in reversed(original[end - 1].encode("utf-8", "surrogatepass")))
            end = back[end]
        yield word, out[::-1]


class Codec:
    def __init__(self, table: PieceTable):
        self.table, self.coder = table, WordCoder(self._new, "", "", CACHE_WORDS)

    @classmethod
    def of(cls, path: str) -> "Codec":
        return common.made(("sentencepieces", path), lambda: cls(PieceTable.load(path)))

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = dict(shared_prefix_viterbi(words, self.table))
        sizes = np.array([len(found[w]) for w in words], np.int64)
        return np.array([p for w in words for p in found[w]], np.int32), np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it."""
        flat, offsets = self.coder.encode(pa.array(texts, pa.string()))
        empty = [i for i, t in enumerate(texts) if not t]  # an empty text has no word, so no mark
        if empty:
            drop = np.zeros(len(flat), bool)
            for i in empty:
                drop[offsets[i] : offsets[i + 1]] = True
            offsets = np.concatenate([[0], np.cumsum(np.where([not t for t in texts], 0, np.diff(offsets)))])
            flat = flat[~drop]
        return flat, offsets

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.surface.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _encode(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(path)
    for b in common.pieces(batches, LETTERS, keep_made=True):
        texts = common.text_list(b)
        flat, offsets = codec.encode(texts)
        ids = [flat[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        arrays = [common.column(b, c) for c in keep]
        if with_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())))
        arrays += [pa.array(np.diff(offsets), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([codec.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, keep + ["ids"] * with_ids + ["n_pieces", "ids_crc32", "restored"])


def encode(documents: DataFrame, model_path: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """Columns `keep`, then ids (array<int>, if asked for), n_pieces, ids_crc32 and restored: whether decoding gives the text again."""
    schema = ", ".join([f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>"] * with_ids + ["n_pieces long, ids_crc32 long, restored boolean"])
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: _encode(it, model_path, keep, with_ids), schema)

"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi pass.

The automaton over all pieces reads a text once; at each position the pieces
that end there, longest first along the output links, relax the best score of
that position. Ties keep the longer last piece. A character without a piece of
its own costs ``UNKNOWN_COST`` below the worst score and is written as byte
pieces (as the unknown piece in a vocabulary without them).

No piece holds a space mark after another character, so no piece crosses from
one word to the next, and words can be segmented apart: the best segmentation
of the whole text is that of its words, one after the other. Workers keep the
segmentations of the words they meet, in a table of bounded size.

``decode(encode(text)) == text`` for every text: the space mark itself, where a
text has it, is written as bytes, unlike the space that it stands for.

With a vocabulary that was made by merges (BPE), the ids are those with the
best sum of the vocabulary's scores, which is what this method defines; the
merge order gives other segmentations of the same text.

Defined cases: null and empty texts have no tokens and are decoded to the empty
text; very long words are segmented without being kept; repeated rows and an
empty table work; extra columns pass through, except those named as results.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import cached_property
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, packed, unpacked

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words kept by a worker, and the longest that is.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64


class Vocabulary:
    """Pieces with scores. Small (tens of thousands of rows), so it travels with a task's code; the automaton is built where it is used."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, special: set[int]):
        self.pieces, self.scores, self.byte_ids, self.unknown, self.special = pieces, scores, byte_ids, unknown, special
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses from one word to the next")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], byte_ids, model.unk_id(), special)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "single", "worst", "table", "kept")}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        skipped = self.special | set(self.byte_ids.values())
        for i, piece in enumerate(self.pieces):
            if i not in skipped and piece:
                made.add_word(piece, (len(piece), i, self.scores[i]))
        made.make_automaton()
        return made

    @cached_property
    def single(self) -> frozenset[str]:
        """Characters that are pieces."""
        return frozenset(p for p, _ in self.automaton.items() if len(p) == 1)

    @cached_property
    def worst(self) -> float:
        skipped = self.special | set(self.byte_ids.values())
        return min((s for i, s in enumerate(self.scores) if i not in skipped), default=0.0) - UNKNOWN_COST

    @cached_property
    def table(self) -> list[bytes]:
        """Each id's bytes when decoded."""
        values = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [values.get(i, b"" if i in self.special else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]

    @cached_property
    def kept(self) -> dict[str, bytes]:
        return {}

    def unknown_ids(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unknown]

    def viterbi(self, word: str) -> list[int]:
        """The ids with the best sum of scores for a text with space marks."""
        if not self.single.issuperset(word):
            return self._viterbi_with_unknown(word)
        # every position can be reached; pieces come by their end, the longest first
        best, back = [0.0] + [-inf] * len(word), [None] * (len(word) + 1)
        for end, piece in self.automaton.iter(word):
            total = best[end + 1 - piece[0]] + piece[2]
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        out, at = [], len(word)
        while at:
            size, i, _ = back[at]
            out.append(i)
            at -= size
        out.reverse()
        return out

    def _viterbi_with_unknown(self, word: str) -> list[int]:
        n = len(word)
        best, back, alone, settled = [0.0] + [-inf] * n, [(0, 0)] * (n + 1), bytearray(n), 0

        def settle(upto: int) -> None:
            """A character that no piece is alone may be unknown; every position up to here is then final."""
            for at in range(settled, upto):
                if not alone[at] and best[at] + self.worst > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.worst, (1, -1)

        for end, (size, i, score) in self.automaton.iter(word):
            if end > settled:
                settle(end)
                settled = end
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (size, i)
            if size == 1:
                alone[end] = 1
        settle(n)
        out, at = [], n
        while at:
            size, i = back[at]
            out.append([i] if i >= 0 else self.unknown_ids(word[at - size : at]))
            at -= size
        return [i for ids in reversed(out) for i in ids]

    def word(self, word: str) -> bytes:
        """The ids of a text with space marks, as 32-bit integers."""
        ids = self.kept.get(word)
        if ids is None:
            ids = array("i", self.viterbi(word)).tobytes()
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                self.kept[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPACE not in text:
            return b"".join(self._words(" " + text))
        mark = np.array(self.unknown_ids(SPACE), np.int32).tobytes()
        parts = text.split(SPACE)  # the marks that the text itself has
        return mark.join(b"".join(self._words(p)) for p in [" " + parts[0], *parts[1:]])

    def _words(self, text: str) -> Iterable[bytes]:
        marked = text.replace(" ", SPACE)
        words = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked) if SPACE * 2 in marked else [SPACE + w for w in text[1:].split(" ")] if text[:1] == " " else [w for w in re.split(f"(?={SPACE})", marked) if w]
        kept, slow = self.kept, self.word
        return [kept.get(w) or slow(w) for w in words]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        joined = b"".join(map(self.table.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the column ``text``, with n_tokens, ids, and round_trip: whether the ids decode to the text."""
    results = ["n_tokens", "ids", "round_trip"]
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary's size doesn't depend on the data

    def compute(texts: list[str | None]) -> list[pa.Array]:
        v = held.value
        packed = [v.encode(t) for t in texts]
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        values = np.frombuffer(b"".join(packed), np.int32)
        same = [v.decode_bytes(np.frombuffer(p, np.int32).tolist()) == (t or "").encode() for p, t in zip(packed, texts, strict=True)]
        return [pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())), pa.array(same, pa.bool_())]

    body = docs.select(packed(docs, [text, *results]).alias("_row"), F.col(text).cast("string").alias("_text"))
    made = append_columns(body, ["_text"], [("n_tokens", "long"), ("ids", "array<int>"), ("round_trip", "boolean")], compute)
    return made.select(*unpacked("_row", docs, [text, *results]), *results)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The rows without the column ``ids``, with the text that they stand for (null ids: null)."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def compute(lists: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([None if x is None else held.value.decode(x) for x in lists], pa.string())]

    body = rows.select(packed(rows, [ids, "text"]).alias("_row"), F.col(ids).alias("_ids"))
    return append_columns(body, ["_ids"], [("text", "string")], compute).select(*unpacked("_row", rows, [ids, "text"]), "text")

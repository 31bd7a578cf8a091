"""Operator 2: sentencepiece encoding and decoding as a weighted transducer.

Normaliser, pieces and byte fallback are arcs; a text is composed with them word
by word (no piece spans words) and the shortest path in the tropical semiring is
its encoding. Unigram models weigh arcs by negated score. For BPE models scores
order merges and don't add up, so every arc weighs one and the states are pieces:
an arc exists only where its piece may follow the state's piece, which leaves one
path, so there the composition decides and not the weights.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillstream.llm.common import map_rows
from quillstream.llm.pieces import BPE, BYTE, CONTROL, SPACE, UNKNOWN, PieceModel, words_of

#: Words remembered in each of two generations, and the longest ones: together a bound in bytes.
MAX_WORDS = 500_000
MAX_CHARS = 64
#: Pairs of neighbouring pieces remembered.
MAX_ARCS = 2_000_000
#: Score of a character without a piece, below the worst piece by this much.
UNKNOWN_PENALTY = 10.0


class PieceTransducer:
    def __init__(self, model: PieceModel):
        self.model = model
        # Words without their leading blank; what was met lately, and what was met before that.
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        floor = min(model.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.weight = lambda p: -model.scores.get(p, floor)
        self.spelled = self._spellings()
        # Arcs by number: what starts a piece, the piece or -1, and the packed ids that an arc emits.
        self.numbers: dict[str, int] = {p: model.ids.get(p, -1) for p in model.prefixes}
        self.emits: dict[int, bytes] = {i: self._packed(p) for p, i in model.ids.items()}
        self.single: dict[str, int] = {}
        self.follows: dict[int, bool] = {}

    def _packed(self, piece: str) -> bytes:
        return np.array(self.model.symbol_ids(piece), dtype="<u4").tobytes()

    def _character(self, ch: str) -> int:
        """Number of the arc of a character without a piece of its own."""
        number = self.single.get(ch)
        if number is None:
            number = self.single[ch] = len(self.model.names) + len(self.single)
            self.emits[number] = self._packed(ch)
        return number

    def lightest(self, word: str) -> list[str]:
        """Pieces on the lightest path where arcs weigh their negated scores: one state for each place."""
        model, n = self.model, len(word)
        best, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for at in range(n):
            for end in range(at + 1, min(n, at + model.longest) + 1):
                piece = word[at:end]
                if end > at + 1 and piece not in model.prefixes:
                    break
                if (end == at + 1 or piece in model.ids) and best[at] + self.weight(piece) < best[end]:
                    best[end], came[end] = best[at] + self.weight(piece), at
        path, end = [], n
        while end:
            path.append(word[came[end]:end])
            end = came[end]
        return path[::-1]

    def merged_path(self, word: str) -> bytes:
        """Packed ids of the path where states are pieces and arcs weigh one.

        The start of a word up to a place has one split whose neighbours may stand
        side by side, so a place is reached by one state at most: the piece that
        ends there. It is kept in an array over places, and a place once reached
        is not looked at again.
        """
        n, numbers, follows, longest = len(word), self.numbers, self.follows, self.model.longest
        arrived, came = [-1] * (n + 1), [0] * (n + 1)
        arrived[0] = 0
        for at in range(n):
            state = arrived[at]
            if state < 0:
                continue
            # the start of the word is a state of its own
            row = (state + 1 if at else 0) << 24
            for end in range(at + 1, min(n, at + longest) + 1):
                piece = word[at:end]
                number = numbers.get(piece)
                if number is None or number < 0:
                    if end == at + 1:
                        number = self._character(piece)
                    elif number is None:
                        break
                    else:
                        continue
                if arrived[end] >= 0:
                    continue
                good = follows.get(row | number)
                if good is None:
                    if len(follows) > MAX_ARCS:
                        follows.clear()
                    expected = [word[came[at]:at], piece] if at else [piece]
                    good = follows[row | number] = self.model.merged("".join(expected)) == expected
                if good:
                    arrived[end], came[end] = number, at
        path, end = [], n
        while end:
            path.append(self.emits[arrived[end]])
            end = came[end]
        return b"".join(path[::-1])

    def word(self, word: str) -> bytes:
        """Ids of a word with its leading blanks, as little-endian 32-bit integers."""
        return self.merged_path(word) if self.model.kind == BPE else b"".join(map(self._packed, self.lightest(word)))

    def learned(self, part: str) -> bytes:
        """Ids of a word after one blank, remembered."""
        found = self.before.get(part) or self.word(SPACE + part)
        if len(part) <= MAX_CHARS:
            if len(self.words) >= MAX_WORDS:
                self.words, self.before = {}, self.words
            self.words[part] = found
        return found

    def encode(self, text: str) -> bytes:
        escaped = self.model.escaped(text)
        if not escaped:
            return b""
        parts = escaped[1:].split(SPACE) if escaped[0] == SPACE else [""]
        if "" in parts:
            return b"".join(map(self.word, words_of(escaped)))
        out = []
        for part in parts:
            out.append(self.words.get(part) or self.learned(part))
        return b"".join(out)

    def _spellings(self) -> list[bytes]:
        model, out = self.model, []
        for name, kind in zip(model.names, model.kinds):
            if kind == BYTE:
                out.append(bytes([int(name[3:-1], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            else:
                out.append(" ⁇ ".encode() if kind == UNKNOWN else name.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=2)
def compiled(model_path: str) -> PieceTransducer:
    """One transducer for each model and Python worker, whose later tasks find what earlier ones have learned."""
    return PieceTransducer(PieceModel.load(model_path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``: ids as an array, empty for a null or empty text."""
    def make():
        machine = compiled(model_path)
        return lambda c: {"doc_id": c["doc_id"], "ids": [np.frombuffer(machine.encode(t or ""), dtype="<u4").astype(np.int32) for t in c["text"]]}
    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded rows; null ids decode to an empty text."""
    def make():
        machine = compiled(model_path)
        return lambda c: {"doc_id": c["doc_id"], "text": [machine.decode(np.array(i or [], dtype="<u4").tobytes()) for i in c["ids"]]}
    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode, decode and digest in one pass: (doc_id, n_ids, ids_crc32, decoded_sha256, same_text).

    One row for every row of ``docs``, whatever its doc_id; a null text is empty.
    Other columns are ignored, and no rows give no rows.
    ``same_text`` is false only where the text holds the visible blank itself.
    """
    def make():
        machine = compiled(model_path)

        def work(c):
            out = {k: [] for k in ("n_ids", "ids_crc32", "decoded_sha256", "same_text")}
            for text in c["text"]:
                ids = machine.encode(text)
                back = machine.decode(ids)
                out["n_ids"].append(len(ids) // 4)
                out["ids_crc32"].append(zlib.crc32(ids))
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                out["same_text"].append(back == text)
            return {"doc_id": c["doc_id"], **out}
        return work

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, make, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same_text boolean")

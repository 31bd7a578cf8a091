"""A sentencepiece model file, and which of its pieces may follow one another.

A BPE model merges the neighbours whose joint piece scores best until none can be
merged. Its result is the one split into pieces in which every two neighbours
stand as they are when encoded on their own, so it can be followed from left to
right with the pieces as states; ``follows`` is that relation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SPACE = "▁"
#: Kinds of pieces and models as numbered in the public model format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

_MEMO = 400_000


@dataclass
class PieceModel:
    """Pieces with ids and scores, the normaliser's switches and the byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    names: list[str]
    kinds: list[int]
    unknown: int
    kind: int
    dummy_prefix: bool
    longest: int = 0
    prefixes: set[str] = field(default_factory=set)
    growing: set[str] = field(default_factory=set)
    _follows: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, train = proto.normalizer_spec, proto.trainer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with escaped, kept blanks is compiled")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not compiled")
        text = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        by_byte = [i for i, p in enumerate(proto.pieces) if p.type == BYTE]
        model = cls(
            ids=text, scores={p: proto.pieces[i].score for p, i in text.items()}, byte_ids=by_byte if train.byte_fallback else [],
            names=[p.piece for p in proto.pieces], kinds=[p.type for p in proto.pieces],
            unknown=next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), kind=train.model_type,
            dummy_prefix=rules.add_dummy_prefix)
        model.longest = max(map(len, text), default=1)
        model.prefixes = {p[:k] for p in text for k in range(1, len(p) + 1)}
        model.growing = {p[:k] for p in text for k in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("a piece spans two words")
        return model

    def escaped(self, text: str) -> str:
        """The normaliser: blanks become visible, a text that isn't empty starts with one."""
        return (SPACE * self.dummy_prefix + text.replace(" ", SPACE)) if text else ""

    def symbol_ids(self, piece: str) -> list[int]:
        """Ids of a piece, or of a character without one."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def cost(self, piece: str) -> int:
        """How many ids a piece, or a character without one, becomes."""
        return 1 if piece in self.ids or not self.byte_ids else len(piece.encode())

    def merged(self, text: str) -> list[str]:
        """BPE by definition; only for the short strings of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            joint = [(self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not joint:
                break
            i = -max(joint)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may come after ``left`` (None: at the start of a word)."""
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) > _MEMO:
                self._follows.clear()
            expected = [right] if left is None else [left, right]
            known = self._follows[left, right] = self.merged("".join(expected)) == expected
        return known


def words_of(text: str) -> list[str]:
    """Escaped text cut before every blank that follows another character: no piece spans such a place."""
    out, start = [], 0
    for i in range(1, len(text)):
        if text[i] == SPACE and text[i - 1] != SPACE:
            out.append(text[start:i])
            start = i
    out.append(text[start:])
    return out

"""Ids of whole texts by the tokenizers library, remembered by blank-separated chunk."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks remembered at most, those met lately and those met before them together; longer ones are not.
MAX_WORDS = 1_600_000
MAX_BYTES = 64
#: Bytes of texts that are looked at together, give or take a text.
TOGETHER = 1 << 23
#: ASCII punctuation that no token shares with a letter before it; not the apostrophe, nor what special strings are made of.
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'<|>")
_TAIL = TAIL.encode()


class WordIds:
    """The library's ids of a text, for tokenizers that drop white space before they look at a text.

    No token of such a tokenizer depends on both sides of an ASCII blank, so a
    text's ids are those of its chunks in a row. New chunks go to the library as
    one text per batch and are told apart by the offsets it returns.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        if self._ids("a b") != self._ids("a \t\n b ") or self._ids("a b") != self._ids("a") + self._ids("b"):
            raise ValueError("this tokenizer keeps white space")
        self.lowers = self._ids("Ab CD") == self._ids("ab cd")
        #: Whether a letter and punctuation behind it are always apart.
        self.cuts = all(self._ids(w + t + u) == self._ids(w) + self._ids(t + u) for w in ("ab", "thing", "É") for t in TAIL for u in ("", t, "."))
        self.direct = self._direct()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self) -> bool:
        """Whether words of the letters a to z reach the library's model as they are."""
        tok, letters = self.tokenizer, "abcdefghijklmnopqrstuvwxyz"
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        if tok.normalizer is None or tok.pre_tokenizer is None or any(c.isascii() and c.isalpha() for c in added):
            return False
        samples = [*letters, letters, letters[::-1], *(a + b for a in letters for b in letters)]
        return all(tok.normalizer.normalize_str(s) == s and tok.pre_tokenizer.pre_tokenize_str(s) == [(s, (0, len(s)))]
                   and [t.id for t in tok.model.tokenize(s)] == self._ids(s) for s in samples)

    def _learn(self, raw: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks; a word and the punctuation behind it are learned apart, as many chunks share a word."""
        if not self.cuts:
            return self._asked(raw)
        apart, parts, known, before = [], set(), self.known, self.before
        for chunk in raw:
            stem = chunk.rstrip(_TAIL)
            if len(stem) < len(chunk) and stem and (stem[-1:].isalpha() or stem[-1] > 127 and stem.decode()[-1].isalpha()):
                tail = chunk[len(stem):]
                apart.append((chunk, stem, tail))
                if stem not in known and stem not in before:
                    parts.add(stem)
                if tail not in known:
                    parts.add(tail)
            else:
                parts.add(chunk)
        found = self._asked(list(parts))
        for chunk, stem, tail in apart:
            found[chunk] = (found.get(stem) or known.get(stem) or before[stem]) + (found.get(tail) or known[tail])
        return found

    def _asked(self, raw: list[bytes]) -> dict[bytes, bytes]:
        """Ids by the library, by its model alone for what its other steps leave as it is."""
        known = {}
        if self.direct:
            ask = self.tokenizer.model.tokenize
            known = {c: np.array([t.id for t in ask(c.decode())], dtype="<u4").tobytes() for c in raw if c.isalpha() and c.islower()}
            raw = [c for c in raw if c not in known]
        if not raw:
            return known
        chunks = [c.decode() for c in raw]
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) + 1
        starts = np.cumsum(sizes) - sizes
        found = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        owner = np.searchsorted(starts, np.fromiter(map(itemgetter(0), found.offsets), dtype=np.int64, count=len(ids)), "right") - 1
        packed, ends = ids.tobytes(), (np.searchsorted(owner, np.arange(len(chunks)), "right") * 4).tolist()
        known.update((chunk, packed[a:b]) for chunk, a, b in zip(raw, [0, *ends], ends))
        return known

    def _remember(self, chunks: list[bytes]) -> set[bytes]:
        """Have the ids of all chunks in ``known``; returned are those that were in neither memory."""
        if len(self.known) > MAX_WORDS // 2:
            self.known, self.before = {}, self.known
        new = {c for c, ids in zip(chunks, map(self.known.get, chunks)) if ids is None}
        again = new.intersection(self.before)
        self.known.update((chunk, self.before[chunk]) for chunk in again)
        new -= again
        asked = list(new)
        for i in range(0, len(asked), 20_000):
            self.known.update(self._learn(asked[i:i + 20_000]))
        return new

    def _packed(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        # Every distinct chunk is looked up once; the texts' ids are then gathered by the numbers of their chunks.
        words = split.values.dictionary_encode()
        distinct = words.dictionary
        if self.lowers:  # the library lower-cases, so ASCII chunks may be lowered before they are looked up
            plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<|")))
            distinct = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        chunks = distinct.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        new = self._remember(chunks)
        found = list(map(self.known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > MAX_BYTES:
                del self.known[chunk]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts, number = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        size = sizes[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(starts[number] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = (ends[split.offsets.to_numpy()] * 4).tolist()
        for start, end in zip(cuts, cuts[1:]):
            yield ids[start:end]

    def packed(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; none for a null or blank one."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string())
        step = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TOGETHER
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for start, end in zip(edges, edges[1:]):
            yield from self._packed(texts.slice(start, end - start))


@functools.lru_cache(maxsize=2)
def remembered(path: str) -> WordIds:
    """One ``WordIds`` per tokenizer and Python worker: what a task has learned serves the worker's next ones."""
    return WordIds(path)

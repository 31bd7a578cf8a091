"""Operator 3: substring dedup by recompression.

Words are named by hashes, then in rounds runs of one symbol and pairs of two are
renamed. A name is computed from the parts it stands for, so every task gives
equal parts equal names without a dictionary. What a round decides about a symbol
depends on its neighbours only; each symbol carries the range of words its
existence depends on, and a symbol whose range lies inside a window appears in
every copy of the window. Beside its name, which stands for its own words, it has a
sealed name, made in the same rounds from the sealed names of its parts and of the
neighbours that decided about it, which stands for the whole range. The smallest
sealed name is the window's key; a window with none, inside a long run, is its own key.

Windows of keys that only one document has are unique. Equal stretches of windows
settle the rest, and where a key is met in different stretches the windows
themselves are compared, by hashes of 128 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillstream.llm import spans
from quillstream.llm.common import BLANKS, map_rows, written

WINDOW = 50
ROUNDS = 3

_U64 = np.uint64
_FAR = 1 << 40
#: Odd multipliers that tell a member of a run, what is before and what is behind apart in a sealed name.
_SEALS = (_U64(0xA24BAED4963EE407), _U64(0x9FB21C651E98DF25), _U64(0xD6E8FEB86659FD93))
#: Low bits that hold a symbol's place while names are compared.
_PLACE = _U64((1 << 22) - 1)


def word_names(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], dtype=_U64)


def recompressed(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sealed name, low, high) of the symbols after ``rounds``: each depends on words low to high alone."""
    n = len(names)
    name, seal, low, high = names, names, np.arange(n), np.arange(n) + 1
    for level in range(rounds):
        # Runs: a run ends where its neighbours differ, so it depends on them.
        edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
        start, length = edge[:-1], np.diff(edge)
        last = len(name) - 1
        before = np.where(start > 0, low[start - 1], -_FAR)
        after = np.where(edge[1:] <= last, high[np.minimum(edge[1:], last)], _FAR)
        name = np.where(length > 1, spans.mixed(name[start] + length.astype(_U64) * _U64(0x9E3779B97F4A7C15)), name[start])
        within = spans.mixed(seal + (np.arange(last + 1) - np.repeat(start, length)).astype(_U64) * _SEALS[0])
        inside = np.add.reduceat(within, start) if len(start) else within
        seal = spans.mixed(seal[start - 1] * _SEALS[1] + inside + seal[np.minimum(edge[1:], last)] * _SEALS[2] + name) if len(start) else seal
        low, high = before, after
        # Pairs: names are dealt into left and right ones; a left one and a right one behind it become one.
        side = (spans.mixed(name + _U64(level + 1)) & _U64(1)).astype(bool)
        meets = ~side[:-1] & side[1:]
        left = np.concatenate([meets, [False]])
        right = np.concatenate([[False], meets])
        seen_low = np.where(side & ~right, np.concatenate([[-_FAR], low[:-1]]), low)
        seen_high = np.where(~side & ~left, np.concatenate([high[1:], [_FAR]]), high)
        joint = np.flatnonzero(left)
        # a right one that stays alone was told by the one before it, a left one by the one behind it
        seal = spans.mixed(np.where(side, np.roll(seal, 1) * _SEALS[1] + seal, seal * _SEALS[2] + np.roll(seal, -1)) + left.astype(_U64))
        name = name.copy()
        name[joint] = spans.mixed(name[joint] * _U64(0x2545F4914F6CDD1D) + name[joint + 1] + _U64(level))
        seen_low[joint] = np.minimum(low[joint], low[joint + 1])
        seen_high[joint] = np.maximum(high[joint], high[joint + 1])
        keep = ~right
        name, seal, low, high = name[keep], seal[keep], seen_low[keep], seen_high[keep]
    return seal, low, high


def window_keys(values: np.ndarray, hashes: spans.Hashes, window: int = WINDOW, rounds: int = ROUNDS):
    """For every window its owner, and a function from owners to keys.

    The owner is the symbol of the smallest sealed name among those that depend on
    the window alone, and that name the key; or -1 less the window, keyed by its words.
    """
    n = len(values) - window + 1
    name, low, high = recompressed(values, rounds)
    inner = (low >= 0) & (high <= len(values)) & (high - low <= window)
    name, low, high = name[inner], low[inner], high[inner]
    first = np.searchsorted(low, np.arange(n), "left")
    after = np.searchsorted(high, np.arange(n) + window, "right")
    # Smallest name of a range of symbols, from two minima over a power of two; the place breaks ties.
    coded = name & ~_PLACE | np.arange(len(name), dtype=_U64)
    owner = -1 - np.arange(n)
    some = np.flatnonzero(after > first)
    level = np.frexp((after - first)[some].astype(float))[1] - 1
    minima = coded
    for k in range(int(level.max(initial=-1)) + 1):
        at = some[level == k]
        owner[at] = (np.minimum(minima[first[at]], minima[after[at] - (1 << k)]) & _PLACE).astype(np.int64)
        minima = np.minimum(minima[:-(1 << k)], minima[1 << k:])

    def key_of(owners: np.ndarray, windows: np.ndarray) -> np.ndarray:
        alone = owners < 0
        key = np.empty(len(owners), dtype=_U64)
        key[~alone] = name[owners[~alone]]
        if alone.any():
            key[alone] = hashes.of(0, windows[alone], windows[alone] + window)
        return key

    return owner, key_of


def cut(powers, texts: list[str], window: int = WINDOW) -> list[tuple]:
    names = [word_names(t.encode().split()) for t in texts]
    return spans.stretches(powers, names, window, lambda values, hashes: window_keys(values, hashes, window))


def deduplicated(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, n_words, n_removed, removed, kept) for every row of ``docs`` (doc_id, text).

    Words covered by a window that also starts in a row of smaller doc_id go;
    ``removed`` lists their stretches as [start, end) in words. ``kept`` has the
    rest joined by one space, or the text as it is where nothing goes. A null or empty text has no words and stays. Rows with
    one doc_id don't affect each other; a null doc_id comes after all others. Texts
    of fewer words than a window stay whole. Of the other columns those in ``carry``
    come along in the struct ``extra`` (which is just true without any).
    """
    def stretch_maker():
        powers = spans.both_powers()
        return lambda texts: cut(powers, texts, window)

    store = spans.stored(docs, stretch_maker, list(carry))
    found = spans.exploded(store)
    met = spans.shared(found, F.min("rank"))
    mine = written(found.join(met, ["name", "e1", "e2"]).select("row", "rank", "first", "last", "first_row", "variants"), "stretches")
    whole = mine.where("first_row < rank").select("row", F.struct("first", "last").alias("range"))
    open_ = mine.where("first_row = rank AND variants > 1")
    asked = spans.with_lists(store, open_, F.struct("first", "last"), "inner")

    def windows():
        powers = spans.both_powers()

        def work(c):
            out = {k: [] for k in ("row", "rank", "h1", "h2", "at")}
            for row, rank, data, ranges in zip(c["row"], c["rank"], c["packed"], c["found"]):
                hashes = spans.Hashes(powers, word_names(spans.unpacked(data).encode().split()))
                at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges]))
                h1, h2 = (spans.signed(hashes.of(k, at, at + window)) for k in (0, 1))
                for name, values in zip(out, ([row] * len(at), [rank] * len(at), h1.tolist(), h2.tolist(), at.tolist())):
                    out[name] += values
            return out
        return work

    single = written(map_rows(asked, windows, "row bigint, rank bigint, h1 bigint, h2 bigint, at bigint", rows=32), "windows")
    least = single.groupBy("h1", "h2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").drop("most")
    again = single.join(least, ["h1", "h2"]).where("least < rank").select("row", F.struct(F.col("at").alias("first"), F.col("at").alias("last")).alias("range"))
    ranges = spans.with_lists(store, whole.unionByName(again), "range", "left")

    def remove():
        def work(c):
            out = {k: [] for k in ("n_words", "n_removed", "removed", "kept")}
            for data, found in zip(c["packed"], c["found"]):
                text = spans.unpacked(data)
                words = text.encode().split()
                gone = spans.covered(len(words), found or [], window)
                edge = spans.edges(gone)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["removed"].append(edge.tolist())
                out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode() if len(edge) else text)
            return {"row": c["row"], "doc_id": c["doc_id"], "extra": c["extra"], **out}
        return work

    extra = store.schema["extra"].dataType.simpleString()
    return map_rows(ranges, remove, f"row bigint, doc_id bigint, extra {extra}, n_words bigint, n_removed bigint, removed array<bigint>, kept string", rows=128)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``deduplicated``; the digest is of kept words joined by one space."""
    cut_ = deduplicated(docs, window)
    words = F.array_join(F.array_remove(F.split("kept", f"[{BLANKS}]+"), ""), " ")
    return cut_.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"))

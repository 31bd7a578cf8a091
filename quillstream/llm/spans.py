"""Shared by the two operators on repeated passages: windows, their keys, and who shares them.

Every window of a text (so many words, or bytes) has one key that only the
window's content decides, so equal windows have equal keys. Neighbouring windows
mostly have the same key; such a run of windows, with all it covers, is a stretch.
Only stretches are shuffled: equal stretches settle all their windows at once, and
a key met in different stretches is looked into further.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from quillstream.llm.common import map_rows, written

_U64 = np.uint64
_MIX = (_U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB))
#: Multipliers of the two polynomials modulo 2**64; together a hash of 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U64(30)) * _MIX[0]
    x = (x ^ x >> _U64(27)) * _MIX[1]
    return x ^ x >> _U64(31)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            size = max(n, 4096)
            self.up, self.down = (_cumulated(b, size) for b in (self.base, self.inverse))
        return self


def _cumulated(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=_U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Hashes:
    """Hashes of any range of a sequence of 64-bit values, from two prefix sums."""

    def __init__(self, powers: tuple[Powers, Powers], values: np.ndarray):
        self.powers = [p.upto(len(values) + 1) for p in powers]
        self.sums = []
        for p in self.powers:
            total = np.zeros(len(values) + 1, dtype=_U64)
            np.cumsum(values * p.up[:len(values)], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p, total = self.powers[which], self.sums[which]
        return mixed((total[end] - total[start]) * p.down[start] + (end - start).astype(_U64))


def both_powers() -> tuple[Powers, Powers]:
    return Powers(_BASES[0]), Powers(_BASES[1])


#: Values that are looked at together: several short texts, or a part of a long one.
TOGETHER = 1 << 19


def stretches(powers: tuple[Powers, Powers], texts: list[np.ndarray], window: int, keys: Callable) -> list[tuple[np.ndarray, ...]]:
    """For every text (as 64-bit values) its stretches: key, 128 bits of all it covers, first and last window.

    ``keys(values, hashes)`` gives every window's owner and a function from owners
    to keys; both may depend on the window's own values alone. So a long text may
    be looked at in overlapping parts, and short ones in a row with values between
    them that occur nowhere else.
    """
    out: list[list] = [[] for _ in texts]
    pending, size = [], 0
    for i, values in enumerate(texts):
        for at in range(0, max(len(values) - window + 1, 0), TOGETHER):
            part = values[at:at + TOGETHER + window - 1]
            pending.append((i, at, part))
            size += len(part)
            if size >= TOGETHER:
                _look(powers, pending, window, keys, out)
                pending, size = [], 0
    if pending:
        _look(powers, pending, window, keys, out)
    empty = (np.empty(0, dtype=np.int64),) * 5
    return [tuple(map(np.concatenate, zip(*parts))) if parts else empty for parts in out]


def _look(powers, pending: list, window: int, keys: Callable, out: list) -> None:
    lengths = np.array([len(part) for _, _, part in pending])
    base = np.cumsum(lengths + 1) - lengths - 1
    between = mixed(np.arange(len(pending), dtype=_U64) + _U64(0x5851F42D4C957F2D))
    values = np.concatenate([x for (_, _, part), gap in zip(pending, between) for x in (part, [gap])])[:-1].astype(_U64)
    hashes = Hashes(powers, values)
    owner, key_of = keys(values, hashes)
    part_of = np.repeat(np.arange(len(pending)), lengths - window + 1)
    at = np.concatenate([np.arange(b, b + n - window + 1) for b, n in zip(base, lengths)])
    mine = owner[at]
    edge = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (part_of[1:] != part_of[:-1]), [True]]))
    first, last, where = at[edge[:-1]], at[edge[1:] - 1], part_of[edge[:-1]]
    key = key_of(mine[edge[:-1]], first)
    found = [signed(x) for x in (key, hashes.of(0, first, last + window), hashes.of(1, first, last + window))]
    cuts = np.searchsorted(where, np.arange(len(pending) + 1))
    for k, (i, start, _) in enumerate(pending):
        part = slice(cuts[k], cuts[k + 1])
        shift = start - base[k]
        out[i].append((*(x[part] for x in found), first[part] + shift, last[part] + shift))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def packed(text: str) -> bytes:
    return zstandard.compress(text.encode(), 3)


def unpacked(data: bytes) -> str:
    return zstandard.decompress(data).decode()


def stored(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[tuple]]], carry: list[str]) -> DataFrame:
    """(row, doc_id, rank, extra, packed, name, e1, e2, first, last): the texts, compressed, and their stretches.

    ``extra`` is a struct of the columns ``carry``.

    ``row`` tells rows apart whatever their doc_id. ``rank`` is the doc_id, beyond
    all others for null. ``make()`` returns the function from texts to ``stretches``.
    """
    extra = F.struct(*carry) if carry else F.lit(True)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", extra.alias("extra"), F.coalesce("text", F.lit("")).alias("text"))
    names = ("name", "e1", "e2", "first", "last")

    def work_maker():
        cut = make()

        def work(c):
            found = cut(c["text"])
            return {"row": c["row"], "doc_id": c["doc_id"], "extra": c["extra"], "rank": [(1 << 63) - 1 if d is None else d for d in c["doc_id"]],
                    "packed": [packed(t) for t in c["text"]], **{n: [f[i] for f in found] for i, n in enumerate(names)}}
        return work

    kind = f"row bigint, doc_id bigint, extra {rows.schema['extra'].dataType.simpleString()}, rank bigint, packed binary, " + ", ".join(f"{n} array<bigint>" for n in names)
    return written(map_rows(rows, work_maker, kind, rows=64), "texts")


def exploded(store: DataFrame) -> DataFrame:
    """One row per stretch: (row, rank, name, e1, e2, first, last)."""
    one = F.explode(F.arrays_zip("name", "e1", "e2", "first", "last")).alias("s")
    return store.select("row", "rank", one).select("row", "rank", "s.*")


def shared(found: DataFrame, first) -> DataFrame:
    """(name, e1, e2, first_row, n, variants) of stretches met more than once, or whose key is met in another stretch."""
    contexts = found.groupBy("name", "e1", "e2").agg(first.alias("first_row"), F.count("*").alias("n"))
    names = contexts.groupBy("name").agg(F.count("*").alias("variants"), F.sum("n").alias("total")).where("total > 1")
    return written(contexts.join(names.select("name", "variants"), "name"), "shared")


def with_lists(store: DataFrame, rows: DataFrame, value, how: str) -> DataFrame:
    """Texts with the list of what ``rows`` has about each."""
    lists = rows.groupBy(F.col("row").alias("_row")).agg(F.collect_list(value).alias("found"))
    return store.select("row", "doc_id", "extra", "rank", "packed").join(lists, F.col("row") == F.col("_row"), how).drop("_row")


def covered(n: int, ranges: list, window: int) -> np.ndarray:
    """Which of ``n`` places windows starting in the ranges cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    if ranges:
        np.add.at(step, np.array([r["first"] for r in ranges]), 1)
        np.add.at(step, np.array([r["last"] for r in ranges]) + window, -1)
    return np.cumsum(step)[:n] > 0


def edges(gone: np.ndarray) -> np.ndarray:
    """Start and end of every stretch of true entries."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))

"""Operator 7: suffix-array dedup of byte strings by bounded interval expansion.

Every window of so many bytes has a key: the smallest hash of a short byte string
in it, so equal windows meet under one key. Stretches of windows that are equal
as a whole are settled by counting. Where a key is met in different stretches, one
copy of each goes to the key's task. There a Burrows-Wheeler transform of all of
them is searched backwards, breadth first: expanding intervals of strings of
growing length marks where neighbours in suffix order share no more than that
length. It stops at the window's length; what is unmarked then repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstream.llm import spans
from quillstream.llm.common import arrow_schema, map_rows, written

WINDOW = 400
#: Bytes of the strings that keys are taken from.
GRAM = 40
#: Keys met in more stretches than this are split up by the windows themselves.
MANY = 2000
#: Bytes of stretches that one transform is made of at most, but for a key that alone has more.
TRANSFORM = 1 << 21

_U64 = np.uint64
_PLACE = _U64((1 << 22) - 1)


def window_keys(values: np.ndarray, hashes: spans.Hashes, window: int, gram: int):
    """For every window the place of its smallest gram (leftmost, of equal ones), and a function to the gram's hash."""
    n = len(values) - gram + 1
    places = np.arange(n)
    name = hashes.of(0, places, places + gram)
    least, width = name & ~_PLACE | places.astype(_U64), 1
    span = window - gram + 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[:len(values) - window + 1], least[span - width:][:len(values) - window + 1])
    return (least & _PLACE).astype(np.int64), lambda owners, windows: name[owners]


def cut(powers, texts: list[str], window: int, gram: int) -> list[tuple]:
    values = [np.frombuffer(t.encode(), dtype=np.uint8).astype(_U64) + _U64(1) for t in texts]
    return spans.stretches(powers, values, window, lambda v, hashes: window_keys(v, hashes, window, gram))


def sorted_rotations(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rotations in the order of their first symbols, at least ``least`` of them; which differ from the one before in
    their first ``k`` symbols; ``k``, no more than ``least``).

    Rotations that are equal so far come in any order: intervals hold all of them or none. What is sorted are integers
    that end in the rotation's own number, and only rotations that are not yet alone are sorted again.
    """
    n = len(text)
    bits = max((n - 1).bit_length(), 1)
    used = np.zeros(int(text.max()) + 1, dtype=bool)
    used[text] = True
    code, wide = (np.cumsum(used) - 1).astype(np.uint16)[text], max((int(used.sum()) - 1).bit_length(), 1)
    known = begun = min((64 - bits) // wide, least)
    line = np.zeros(n, dtype=_U64)
    for i in range(known):
        line <<= _U64(wide)
        line |= np.roll(code, -i)
    del code
    line, order = _sorted(line, np.arange(n, dtype=np.uint32), bits, True)
    head = _heads(line)
    del line
    start, at, rows = head.copy(), np.arange(n), order
    rank = np.empty(n, dtype=np.uint32)
    while known < least:
        first = head[at]
        rank[rows] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        if not len(at):
            break
        rows, line = order[at], np.cumsum(head[at], dtype=_U64)
        fits = int(line[-1]).bit_length() + 2 * bits <= 64
        after = rows + np.uint32(known % n)
        after[after >= n] -= np.uint32(n)
        line <<= _U64(bits)
        line |= rank[after]
        del after
        line, rows = _sorted(line, rows, bits, fits)
        order[at], head[at] = rows, _heads(line)
        del line
        known *= 2
    return order, start, begun


def _heads(line: np.ndarray) -> np.ndarray:
    """Which differ from the one before."""
    return np.append(True, line[1:] != line[:-1])


def _sorted(key: np.ndarray, rows: np.ndarray, bits: int, fits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their rows; in one integer if it holds both, as integers sort faster than places of integers.

    That integer takes the key's place: arrays of this length are what a task's memory goes into.
    """
    if not fits:
        at = np.argsort(key)
        return key[at], rows[at]
    key <<= _U64(bits)
    np.bitwise_or(key, rows, out=key, dtype=_U64, casting="unsafe")
    key.sort()
    rows = np.bitwise_and(key, _U64((1 << bits) - 1), out=np.empty(len(key), dtype=rows.dtype), casting="unsafe")
    key >>= _U64(bits)
    return key, rows


def repeated(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For every string, at which places a window starts that starts at another place of any of them too."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8).astype(np.uint16)
    text += np.uint16(1)
    text[np.cumsum(sizes + 1) - 1] = 0
    n = len(text)
    order, start, known = sorted_rotations(text, window)
    bwt = np.roll(text, 1)[order]
    del text
    # Where a place's rotation goes when its symbol is put before it: within a symbol places keep their order.
    before = np.empty(n, dtype=np.uint32)
    before[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.uint32)
    # Neighbours that differ in the first symbols are marked; from there on by length.
    marked = np.append(start, True)
    edge = np.flatnonzero(marked).astype(np.uint32)
    low, high = edge[:-1], edge[1:]
    del start, edge
    for _ in range(known, window):
        if not len(low):
            break
        size = high - low
        bits = 9 + len(low).bit_length()
        pair = np.repeat(np.arange(len(low), dtype=np.uint32 if bits <= 32 else _U64), size)
        rows = np.repeat(low - (np.cumsum(size, dtype=np.int64) - size), size)
        rows += np.arange(len(rows))
        del low, high, size
        # Sorted by where they go, rows of one interval and symbol stand together: an interval of the longer string.
        pair <<= pair.dtype.type(9)
        pair |= bwt[rows]
        to = before[rows].astype(_U64)
        del rows
        to, pair = _sorted(to, pair, bits, n.bit_length() + bits <= 64)
        end = np.flatnonzero(np.append(pair[1:] != pair[:-1], True))
        first, after = (x.astype(np.uint32) for x in (to[np.append(0, end[:-1] + 1)], to[end] + _U64(1)))
        del to, pair, end
        fresh = ~marked[after]
        low, high = first[fresh], after[fresh]
        marked[high] = True
        del first, after
    alike = ~marked[:-1] | ~marked[1:]  # with the one before, or the one behind
    place = np.zeros(n, dtype=bool)
    place[order] = alike
    base = np.cumsum(sizes + 1) - sizes - 1
    return [np.flatnonzero(place[b:b + max(k - window + 1, 0)]) for b, k in zip(base.tolist(), sizes.tolist())]


def _expanded(batches: Iterator[pa.RecordBatch], window: int, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (name, row, first, only, bytes) sorted by name: ranges of repeated windows of those met only once."""
    held: list[tuple] = []
    size = whole = at_name = 0  # bytes held, and bytes and rows of those whose key is complete

    def flush(held: list[tuple]) -> pa.RecordBatch:
        rows, first, last = [], [], []
        for (_, row, start, only, _), at in zip(held, repeated([h[4] for h in held], window)):
            if only and len(at):
                edge = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1, [True]]))
                rows += [row] * (len(edge) - 1)
                first += (at[edge[:-1]] + start).tolist()
                last += (at[edge[1:] - 1] + start).tolist()
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], schema=kinds)

    for batch in batches:
        for record in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if held and record[0] != held[-1][0]:
                whole, at_name = size, len(held)
            if at_name and size + len(record[4]) > TRANSFORM:
                yield flush(held[:at_name])
                held, size, whole, at_name = held[at_name:], size - whole, 0, 0
            held.append(record)
            size += len(record[4])
    if held:
        yield flush(held)


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(row, doc_id, n_bytes, n_removed, removed, kept) for every row of ``docs`` (doc_id, text).

    Bytes covered by a window that also starts anywhere else, in the same text
    or another row, go; ``removed`` lists [start, end) in bytes, ``kept`` has the
    rest as binary. A null text is empty. Copies of a row, and rows with equal or
    null doc_ids, are texts like any other. Other columns are ignored.
    """
    def stretch_maker():
        powers = spans.both_powers()
        return lambda texts: cut(powers, texts, window, gram)

    store = spans.stored(docs, stretch_maker, [])
    found = spans.exploded(store).drop("rank")
    met = spans.shared(found, F.min(F.struct("row", "first")))
    mine = written(found.join(met, ["name", "e1", "e2"]).select("name", "row", "first", "last", "first_row", "n", "variants"), "stretches")
    whole = mine.where("n > 1").select("row", "first", "last")
    one = mine.where("variants > 1 AND first_row.row = row AND first_row.first = first")
    asked = spans.with_lists(store, one, F.struct("name", "first", "last", "n", "variants"), "inner")

    def slices():
        powers = spans.both_powers()

        def work(c):
            out = {k: [] for k in ("name", "row", "first", "only", "bytes", "h1", "h2")}
            for row, data, ranges in zip(c["row"], c["packed"], c["found"]):
                text = spans.unpacked(data).encode()
                hashes = None
                for r in ranges:
                    begin, end, only = r["first"], r["last"] + window, r["n"] == 1
                    if r["variants"] <= many:
                        for name, value in zip(out, (r["name"], row, begin, only, text[begin:end], None, None)):
                            out[name].append(value)
                        continue
                    hashes = hashes or spans.Hashes(powers, np.frombuffer(text, dtype=np.uint8).astype(_U64) + _U64(1))
                    at = np.arange(begin, r["last"] + 1)
                    h1, h2 = (spans.signed(hashes.of(k, at, at + window)).tolist() for k in (0, 1))
                    for name, values in zip(out, ([None] * len(at), [row] * len(at), at.tolist(), [only] * len(at), [None] * len(at), h1, h2)):
                        out[name] += values
            return out
        return work

    parts = written(map_rows(asked, slices, "name bigint, row bigint, first bigint, only boolean, bytes binary, h1 bigint, h2 bigint", rows=16), "slices")
    kind = "row bigint, first bigint, last bigint"
    kinds = arrow_schema(kind)
    grouped = parts.where("bytes IS NOT NULL").select("name", "row", "first", "only", "bytes").repartition("name").sortWithinPartitions("name")
    expanded = grouped.mapInArrow(lambda batches: _expanded(batches, window, kinds), kind)
    single = parts.where("bytes IS NULL").select("row", "first", "only", "h1", "h2")
    twice = single.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    split = single.where("only").join(twice, ["h1", "h2"]).select("row", "first", F.col("first").alias("last"))
    ranges = whole.unionByName(expanded).unionByName(split).select("row", F.struct("first", "last").alias("range"))

    def remove():
        def work(c):
            out = {k: [] for k in ("n_bytes", "n_removed", "removed", "kept")}
            for data, found in zip(c["packed"], c["found"]):
                text = np.frombuffer(spans.unpacked(data).encode(), dtype=np.uint8)
                gone = spans.covered(len(text), found or [], window)
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(gone.sum()))
                out["removed"].append(spans.edges(gone).tolist())
                out["kept"].append(text[~gone].tobytes())
            return {"row": c["row"], "doc_id": c["doc_id"], **out}
        return work

    return map_rows(spans.with_lists(store, ranges, "range", "left"), remove,
                    "row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, removed array<bigint>, kept binary", rows=128)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``deduplicated``."""
    return deduplicated(docs, window).select("doc_id", "n_bytes", "n_removed", F.expr("CAST(size(removed) DIV 2 AS BIGINT)").alias("n_spans"),
                                             F.sha2("kept", 256).alias("kept_sha256"))

"""Operator 10: token ids in files compressed by Re-Pair grammars.

A shard is a run of documents in ascending doc_id order. Its ids are compressed
by replacing frequent pairs by new symbols, many pairs a round, never across the
end of a document. Stored are the rules, how many ids each symbol expands to, the
remaining sequence, and where documents end, so that a document, or any range of
ids, is decoded from the symbols that cover it alone.

File format: a Parquet table with one row per shard.

=============  ===========================================================
part, number   order of the shard: range of doc_ids, place in that range
first_symbol   symbols below are ids, symbol ``first_symbol + r`` is rule r
rules          pairs of little-endian unsigned 32-bit symbols
lengths        unsigned 32-bit number of ids of every rule
low, high      low 16 and next 8 bits of each symbol of the sequence
doc_ids, ends  documents in order, and the shard's ids up to each one's end
=============  ===========================================================
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstream.llm.common import arrow_schema, map_rows
from quillstream.llm.word_ids import remembered
from quillstream.session import shared_dir

SHARD_IDS = 1 << 21
#: A pair is frequent, and worth a rule, from this many times in a shard; rounds go on until none is.
LEAST = 24

_HASH_BITS = 20
_SHARD = """part int, number int, first_symbol bigint, n_ids bigint, rules binary, lengths binary, low binary, high binary,
    doc_ids array<bigint>, ends array<bigint>"""


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules, lengths) of a shard; ``ends`` holds the place behind each document's last id."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[ends[ends > 0] - 1] = True
    last[-1:] = True
    rules, size, made = [np.empty((0, 2), dtype=np.uint32)], np.ones(first_symbol, dtype=np.uint32), 0
    # A pair met too rarely never gets frequent: all its places were there when its symbols were. So after the first
    # round only places with a new symbol are counted, and those whose slot is frequent and stands for another pair.
    open_at = np.flatnonzero(~last)
    while len(open_at):
        key = seq[open_at].astype(np.uint64) << np.uint64(32) | seq[open_at + 1]
        slot = _slot(key)
        # Pairs are counted by slot; a slot stands for one of its pairs, the others wait for the next round.
        often = np.flatnonzero(np.bincount(slot, minlength=1 << _HASH_BITS) >= LEAST)
        if not len(often):
            break
        table = np.full(1 << _HASH_BITS, -1, dtype=np.int32)
        table[often] = np.arange(len(often))
        rule = table[slot]
        at = np.flatnonzero(rule >= 0)
        at, rule, key = open_at[at], rule[at], key[at]
        chosen = np.zeros(len(often), dtype=np.uint64)
        chosen[rule] = key
        own = chosen[rule] == key
        waiting, at, rule = at[~own], at[own], rule[own]
        # Of overlapping places every second one counts, from the left.
        fresh = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        taken = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[taken], rule[taken]
        new = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        size = np.concatenate([size, size[new[:, 0]] + size[new[:, 1]]])
        rules.append(new)
        seq[at], last[at] = rule.astype(np.uint32) + np.uint32(first_symbol + made), last[at + 1]
        made += len(new)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        before = at[at > 0] - 1
        again = np.zeros(len(seq), dtype=bool)
        again[waiting] = again[at] = again[before - ~keep[before]] = True
        seq, last, again = seq[keep], last[keep], again[keep]
        open_at = np.flatnonzero(again & ~last)
    return seq, np.concatenate(rules), size[first_symbol:]


class Shard:
    """Random access to the ids of one stored shard."""

    def __init__(self, row: dict):
        self.first = row["first_symbol"]
        self.rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], dtype="<u4")
        self.seq = np.frombuffer(row["low"], dtype="<u2").astype(np.uint32) | np.frombuffer(row["high"], dtype="u1").astype(np.uint32) << 16
        sizes = np.ones(len(self.seq), dtype=np.int64)
        is_rule = self.seq >= self.first
        sizes[is_rule] = self.lengths[self.seq[is_rule] - self.first]
        self.upto = np.cumsum(sizes)
        self.laid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Rules made in later rounds use earlier ones only, so expansion ends after as many steps as there were rounds."""
        while len(at := np.flatnonzero(symbols >= self.first)):
            wide = np.ones(len(symbols), dtype=np.int64)
            wide[at] = 2
            place = np.cumsum(wide) - wide
            out = np.empty(int(place[-1] + wide[-1]), dtype=np.uint32)
            out[place] = symbols
            pair = self.rules[symbols[at] - self.first]
            out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of all rules are laid out once, behind the plain ids; every symbol then is a range of these."""
        if self.laid is None:
            every = np.arange(self.first + len(self.rules), dtype=np.uint32)
            size = np.concatenate([np.ones(self.first, dtype=np.int64), self.lengths])
            self.laid = self._expanded(every), np.cumsum(size) - size, size
        ids, begin, size = self.laid
        size = size[symbols]
        end = np.cumsum(size)
        return ids[np.repeat(begin[symbols] - end + size, size) + np.arange(end[-1] if len(end) else 0)]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard, from the symbols that cover them."""
        if start >= end:
            return np.empty(0, dtype="<u4")
        low, high = np.searchsorted(self.upto, [start, end - 1], "right")
        before = int(self.upto[low - 1]) if low else 0
        return self.expand(self.seq[low:high + 1])[start - before:end - before].astype("<u4")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text), each followed by ``end_id``, to ``path``.

    Rows are ordered by doc_id, null first; rows with equal doc_ids by a hash of
    their text. A null or empty text is its end id. Other columns are ignored.
    """
    kinds = arrow_schema(_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = remembered(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        first_symbol = tokenizer.tokenizer.get_vocab_size(with_added_tokens=True)
        part, number, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            ends = np.cumsum([len(h) // 4 for h in held])
            seq, rules, lengths = compress(ids, ends, first_symbol)
            if len(rules) + first_symbol > 1 << 24:
                raise ValueError("a symbol has more than 24 bits")
            row = {"part": part, "number": number, "first_symbol": first_symbol, "n_ids": len(ids), "rules": rules.astype("<u4").tobytes(),
                   "lengths": lengths.astype("<u4").tobytes(), "low": (seq & 0xFFFF).astype("<u2").tobytes(), "high": (seq >> 16).astype("u1").tobytes(),
                   "doc_ids": names, "ends": ends.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.packed(batch.column("text"))):
                held.append(ids + end)
                names.append(doc)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield shard()
                    number, held, names, size = number + 1, [], [], 0
        if held:
            yield shard()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    rows.select("doc_id", "text").mapInArrow(run, _SHARD).write.parquet(path)


def _read(spark: SparkSession, path: str, measures: dict[str, tuple[str, Callable[[np.ndarray], object]]]) -> DataFrame:
    """(part, number, doc_id, at) of every stored document, and what the measures (type, function of its ids) say."""
    def make():
        def work(c):
            out = {k: [] for k in ("part", "number", "doc_id", "at", *measures)}
            for i in range(len(c["part"])):
                shard, begin = Shard({k: v[i] for k, v in c.items()}), 0
                whole = shard.ids(0, c["n_ids"][i])
                for doc, end in zip(c["doc_ids"][i], c["ends"][i]):
                    for name, value in zip(out, (c["part"][i], c["number"][i], doc, begin)):
                        out[name].append(value)
                    for name, (_, measure) in measures.items():
                        out[name].append(measure(whole[begin:end]))
                    begin = end
            return out
        return work
    shards = spark.read.schema(_SHARD).parquet(path)
    kinds = "".join(f", {name} {kind}" for name, (kind, _) in measures.items())
    return map_rows(shards, make, f"part int, number int, doc_id bigint, at bigint{kinds}", rows=1)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, doc_id, at, ids): every document's ids as little-endian bytes, and their place in the shard."""
    return _read(spark, path, {"ids": ("binary", np.ndarray.tobytes)})


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document; ``start`` counts the ids of all before it."""
    docs = _read(spark, path, {"n_tokens": ("bigint", len), "ids_crc32": ("bigint", zlib.crc32)})
    shards = spark.read.schema(_SHARD).parquet(path).select("part", "number", "n_ids")
    # Offsets in two steps: within a part by its own window, parts by their totals, one row each.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part_start"))
    inner = shards.select("part", "number", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")).alias("_in_part"))
    offsets = inner.join(parts, "part")
    placed = docs.join(offsets, ["part", "number"])
    return placed.select("doc_id", (F.col("_part_start") + F.col("_in_part") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder and digest what they hold."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write(docs, tokenizer_path, end_id, path)
    return digests(docs.sparkSession, path)

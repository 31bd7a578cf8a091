"""Operator 6: packing by minimum bin slack.

Each bin gets the fullest combination of the lengths still available, found by
subset sums over bits: bit s of a Python integer says that the sum s can be
reached. Equal lengths are alike, so the search runs on the histogram of lengths,
which has at most ``capacity`` rows however many pieces there are; a combination
found once fills as many bins as the counts allow. Pieces then meet their bins by
(length, rank), a join on keys that spreads evenly.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstream.llm.common import map_rows, written
from quillstream.llm.word_ids import remembered

#: Bins of one pattern row; a pattern that fills more is split so that no join key grows with the data.
BINS_PER_ROW = 4096


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document with its end id, cut only where longer than ``capacity``."""
    def make():
        tokenizer, end, step = remembered(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

        def work(c):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(c["doc_id"], tokenizer.packed(c["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for name, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            return out
        return work
    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often each length is used in the fullest feasible bin; the largest length left is always in it."""
    first = max(counts)
    left, chosen = capacity - first, {first: 1}
    items = []  # (length, copies) in powers of two, longest first, so that a traceback prefers long pieces
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == first), left // length)
        size = 1
        while most > 0:
            take = min(size, most)
            items.append((length, take))
            most -= take
            size *= 2
    reach, mask = [1], (1 << (left + 1)) - 1
    for length, take in reversed(items):
        reach.append((reach[-1] | reach[-1] << (length * take)) & mask)
        if reach[-1] >> left & 1:
            break
    goal = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> goal & 1:
            length, take = items[len(items) - k]
            chosen[length] = chosen.get(length, 0) + take
            goal -= length * take
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(uses by length, number of bins), until every piece has a bin."""
    counts, out = dict(counts), []
    while counts:
        uses = fullest(counts, capacity)
        times = min(counts[length] // n for length, n in uses.items())
        for length, n in uses.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        out.append((uses, times))
    return out


def _places(spark: SparkSession, counts: dict[int, int], capacity: int, block: int) -> DataFrame:
    """For each length and block of ranks, the runs of ranks that go to consecutive bins.

    A run (length, block, first, size, sequence, uses, at): rank ``first + i`` goes
    to bin ``sequence + i // uses``, at offset ``at + i % uses * length``.
    """
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for uses, times in patterns(counts, capacity):
        at = 0
        for length, n in sorted(uses.items(), reverse=True):
            rows.append((length, used[length], n * times, sequence, n, at))
            used[length] += n * times
            at += n * length
        sequence += times
    runs = spark.createDataFrame(rows, "length bigint, first bigint, size bigint, sequence bigint, uses bigint, at bigint")
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))
    return runs.withColumn("block", F.explode(blocks))


def pack(found: DataFrame, capacity: int, block: int = BINS_PER_ROW) -> DataFrame:
    """``found`` with (sequence_id, offset) for every row of at most ``capacity`` tokens; row order doesn't matter.

    ``found`` needs the column ``length``; rows are told apart by themselves alone,
    so repeated rows and null ids are packed like any other. The driver sees only
    the histogram of lengths, at most ``capacity`` rows.
    """
    spark = found.sparkSession
    if not found.schema["length"].dataType.typeName() == "long":
        raise TypeError("length must be bigint")
    # Ranks within a length in two steps: within one task's rows, then the tasks' counts before it.
    rows = written(found.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "packing")
    by_part = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = by_part.select("length", "_part", "_n", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    before = written(before, "packing-counts")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if not counts:
        return found.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError(f"lengths must be 1 to {capacity}")
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    # Counts grow with tasks, so they are merged with rows already dealt out by their keys, not broadcast.
    ranked = rows.withColumn("_local", local).join(before.drop("_n").hint("merge"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_local") + F.col("_before")).withColumn("_block", F.floor(F.col("_rank") / block))
    runs = _places(spark, counts, capacity, block).withColumnsRenamed({c: f"_{c}" for c in ("first", "size", "sequence", "uses", "at", "block")})
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_size"))
    placed = ranked.join(runs, ["length", "_block"]).where(inside)
    i = F.col("_rank") - F.col("_first")
    return placed.select(*found.columns, (F.col("_sequence") + F.floor(i / F.col("_uses"))).cast("bigint").alias("sequence_id"),
                         (F.col("_at") + i % F.col("_uses") * F.col("length")).cast("bigint").alias("offset"))


def best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is its end id alone. Equal or null doc_ids are packed row
    by row. No rows give no rows. Every other column is ignored.
    """
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)

"""Operator 8: approximate nearest neighbours on shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and ordered along Hilbert
curves, a projection and a shift for each. Spark range-partitions every order and
cuts it into blocks; a query is compared with the blocks around its own place on
each curve, and the windows' best are merged and ranked by the exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quillstream.llm.common import arrow_schema, map_rows, written

CURVES, DIMENSIONS = 24, 16
#: Halvings of a dimension's range. The first few tell most rows apart; the others order a group that is tight against
#: the whole range as its own vectors lie.
BITS = 20
#: Rows on either side of a query on each curve: this share of all, and at least so many. The share is what recall
#: depends on where vectors have no structure of few dimensions.
SHARE, LEAST = 0.025, 1024
BLOCK_ROWS = 1024
#: Scales are fitted on at most so many vectors, those with the smallest hashed ids.
SAMPLE_ROWS = 4096
#: Queries compared with a block in one step.
QUERIES_A_STEP = 512
_SEED = 8


def precision(vectors: DataFrame, vec: str) -> np.dtype:
    """Four bytes a component where the column holds floats, which are exact in them; eight otherwise."""
    return np.dtype("<f4" if vectors.schema[vec].dataType.elementType.typeName() == "float" else "<f8")


def usable(vectors: DataFrame, dims: int, vec: str = "embedding") -> DataFrame:
    """(vec_id, vector as bytes in its own precision) of vectors of ``dims`` finite components that aren't all zero."""
    good = (F.size(vec) == dims) & F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(F.col(vec).isNotNull()).where(good).select("vec_id", F.col(vec).alias("v"))

    kind = precision(vectors, vec)

    def make():
        return lambda c: {"vec_id": c["vec_id"], "v": [(np.array(v, dtype=kind) + kind.type(0)).tobytes() for v in c["v"]]}
    return map_rows(rows, make, "vec_id bigint, v binary", rows=2048)


def _turned(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Coordinates whose bits, dealt from the highest on, are the place on the Hilbert curve."""
    axes = [np.ascontiguousarray(cells[:, i]) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(len(axes)):
            high = (axes[i] & q) > 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] & (1 << level)) > 0, (1 << level) - 1, 0)
    return [axis ^ turn for axis in axes]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of integer coordinates on the Hilbert curve."""
    axes = _turned(cells.astype(np.int64), bits)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis >> b) & 1
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> list[bytes]:
    """The same places as bytes, in their order, for more bits than a number holds."""
    axes = np.stack(_turned(cells.astype(np.int32), bits), axis=1)
    dealt = np.stack([(axes >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)], axis=1)
    packed = np.packbits(dealt.reshape(len(axes), bits * axes.shape[1]), axis=1)
    return [row.tobytes() for row in packed]


class Curves:
    """Projections, shifts and scales; the same in every task."""

    def __init__(self, dims: int, sample: np.ndarray):
        rng = np.random.default_rng(_SEED)
        self.projections = [np.linalg.qr(rng.normal(size=(dims, min(dims, DIMENSIONS))))[0] for _ in range(CURVES)]
        self.shifts = rng.random((CURVES, min(dims, DIMENSIONS))) * 0.5
        spread = [sample @ p for p in self.projections]
        self.low = [s.min(0) if len(s) else np.zeros(p.shape[1]) for s, p in zip(spread, self.projections)]
        self.width = [np.maximum(s.max(0) - s.min(0), 1e-12) if len(s) else np.ones(p.shape[1]) for s, p in zip(spread, self.projections)]

    def keys(self, x: np.ndarray) -> list[bytes]:
        """Places of all rows on the first curve, then on the second, and so on."""
        cells = []
        for projection, low, width, shift in zip(self.projections, self.low, self.width, self.shifts):
            unit = np.clip((x @ projection - low) / width, 0, 1)
            cells.append(np.minimum(((unit * 0.5 + shift) * (1 << BITS)).astype(np.int32), (1 << BITS) - 1))
        return hilbert_bytes(np.concatenate(cells), BITS)


def _blocks(vectors: DataFrame, curves: Curves, dims: int, kind: np.dtype) -> DataFrame:
    """(curve, part, number, n, vec_ids, vs): every curve's order in blocks of at most BLOCK_ROWS rows."""
    def keys():
        def work(c):
            x = np.frombuffer(b"".join(c["v"]), dtype=kind).reshape(-1, dims).astype(float)
            return {"curve": np.repeat(np.arange(CURVES), len(x)).tolist(), "key": curves.keys(x),
                    "vec_id": c["vec_id"] * CURVES, "v": c["v"] * CURVES}
        return work

    keyed = map_rows(vectors, keys, "curve int, key binary, vec_id bigint, v binary", rows=1024)
    ordered = keyed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id").drop("key")
    schema = "curve int, part int, number int, n int, vec_ids array<bigint>, vs binary"
    kinds = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows):
            return pa.RecordBatch.from_pylist([{"curve": rows[0][0], "part": part, "number": number, "n": len(rows),
                                                "vec_ids": [r[1] for r in rows], "vs": b"".join(r[2] for r in rows)}], schema=kinds)
        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("curve", "vec_id", "v")]):
                if held and (len(held) == BLOCK_ROWS or held[0][0] != row[0]):
                    yield block(held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield block(held)

    return ordered.mapInArrow(cut, schema)


def _copies(good: DataFrame, is_query, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the k + 1 smallest vec_ids of every vector, and (query_id, vec_id, score) of the queries not among them.

    Rows of larger vec_ids are nobody's neighbours by the rule for ties, and would
    fill the windows; where they are queries, k copies of theirs are their answer.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = written(good.dropDuplicates(["vec_id", "v"]).withColumn("_rank", rank).where(F.col("_rank") <= k + 1), "copies")

    def queries():
        def work(c):
            asked = [i for i, vec_id in enumerate(c["vec_id"]) if is_query(vec_id)]
            return {"query_id": [c["vec_id"][i] for i in asked], "v": [c["v"][i] for i in asked]}
        return work

    asked = map_rows(good, queries, "query_id bigint, v binary").distinct()
    asked = asked.join(first.select(F.col("vec_id").alias("query_id"), "v"), ["query_id", "v"], "left_anti")
    near = asked.join(first.where(F.col("_rank") <= k), "v")
    return first.drop("_rank"), near.select("query_id", "vec_id", F.lit(0.0).alias("score"))


def nearest(vectors: DataFrame, dims: int, is_query, k: int = 10, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, by Euclidean distance.

    ``is_query`` is a condition on vec_id. A query isn't its own neighbour, but
    other rows with its vec_id are. Vectors that are null, zero, of another length or not finite
    take no part, nor do rows without a vec_id, which can't be named; without queries
    there are no rows. Equal rows are one candidate. Ties go to the smaller vec_id.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = precision(vectors, vec)
    good = written(usable(vectors, dims, vec).where(F.col("vec_id").isNotNull()), "vectors")
    copies = None
    if not good.groupBy(F.xxhash64("v")).count().where(F.col("count") > k + 1).isEmpty():
        good, copies = _copies(good, is_query, k)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    curves = Curves(dims, np.frombuffer(b"".join(bytes(r["v"]) for r in sample), dtype=kind).reshape(-1, dims).astype(float))
    blocks = written(_blocks(good, curves, dims, kind), "curve-blocks")
    places = Window.partitionBy("curve").orderBy("part", "number")
    total, n_blocks = blocks.where(F.col("curve") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    reach = math.ceil(max(LEAST, SHARE * total) / (total / n_blocks))
    steps = max(1, math.ceil(2 * reach * BLOCK_ROWS / 100 / QUERIES_A_STEP))
    index = blocks.select("curve", "part", "number", (F.row_number().over(places) - 1).alias("place"))

    def queries():
        def work(c):
            out = {k: [] for k in ("curve", "part", "number", "query_id", "q")}
            for curve, part, number, ids, vs in zip(*[c[n] for n in ("curve", "part", "number", "vec_ids", "vs")]):
                for i, vec_id in enumerate(ids):
                    if is_query(vec_id):
                        for name, value in zip(out, (curve, part, number, vec_id, vs[kind.itemsize * dims * i:kind.itemsize * dims * (i + 1)])):
                            out[name].append(value)
            return out
        return work

    asked = map_rows(blocks, queries, "curve int, part int, number int, query_id bigint, q binary", rows=16).join(index, ["curve", "part", "number"])
    asked = asked.withColumn("place", F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)))
    asked = asked.groupBy("curve", "place", F.pmod(F.xxhash64("query_id"), F.lit(steps)).alias("step")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    pairs = asked.join(blocks.join(index, ["curve", "part", "number"]).select("curve", "place", "vec_ids", "vs"), ["curve", "place"])

    def compare():
        def work(c):
            out = {name: [] for name in ("query_id", "vec_id", "score")}
            for asked, ids, vs in zip(c["asked"], c["vec_ids"], c["vs"]):
                x = np.frombuffer(vs, dtype=kind).reshape(-1, dims).astype(float)
                known = np.array(ids, dtype=np.int64)
                for query in asked:
                    q = np.frombuffer(query["q"], dtype=kind).astype(float)
                    far = np.sqrt(((x - q) ** 2).sum(1))
                    own = (known == query["query_id"]) & (far == 0)
                    far[own] = np.inf
                    best = np.lexsort((known, far))[:k]
                    best = best[far[best] < np.inf]
                    out["query_id"] += [query["query_id"]] * len(best)
                    out["vec_id"] += known[best].tolist()
                    out["score"] += far[best].tolist()
            return out
        return work

    found = map_rows(pairs.select("asked", "vec_ids", "vs"), compare, "query_id bigint, vec_id bigint, score double", rows=8)
    if copies is not None:
        found = found.unionByName(copies)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

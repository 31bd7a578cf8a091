"""Operator 4: SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints are dealt out by blocks of their bits: two that differ in
at most ``budget`` bits agree in at least one of ``budget + 1`` blocks. The
fingerprints of a block value form a binary trie, stored as a sorted array whose
nodes are ranges. Pairs of nodes are walked down together, adding up differing
bits, and dropped once the budget is exceeded; walks that reach leaves are links.
Of the links in a block only a minimum spanning forest leaves the task, which
keeps what is connected at every distance without listing a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quillstream.llm import spans
from quillstream.llm.common import arrow_schema, map_rows, written

SEED = 42
BITS = 64
#: Pairs of trie nodes that are walked together.
WALK = 1 << 20
#: Distances up to which links are gathered in turn; what is connected so far isn't walked again.
LEVELS = (1, 3, 6)
_ROUNDS = 200


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words, if fewer; nothing without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    ends = ends[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at:at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# The join within one task -----------------------------------------------------


def trie_links(keys: np.ndarray, groups: np.ndarray, budget: int, tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (i, j, distance), i < j, of the sorted, distinct ``keys`` of one group that differ in at most
    ``budget`` bits and aren't in one ``tree`` yet.

    ``groups`` holds the first row of each group, and the end. A node is a range of
    rows that agree in the bits so far. Batches of node pairs are taken depth
    first, which bounds what is held.
    """
    changes = np.concatenate([[0], np.cumsum(tree[1:] != tree[:-1])])
    start, end = groups[:-1].astype(np.int64), groups[1:].astype(np.int64)
    many = end - start > 1
    start, end = start[many], end[many]
    stack = [(BITS - 1, start, end, start, end, np.zeros(len(start), dtype=np.int64))]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > WALK:
            for at in range(0, len(a0), WALK):
                stack.append((bit, *(x[at:at + WALK] for x in (a0, a1, b0, b1, spent))))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            distance = np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64)
            near = (distance <= budget) & (tree[i] != tree[j])
            yield i[near], j[near], distance[near]
        joined = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (tree[a0] == tree[b0])
        more = ~leaf & ~joined & ((a1 - a0 > 1) | (a0 != b0))
        a0, a1, b0, b1, spent = (x[more] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        am, bm = _middle(keys, a0, a1, bit), _middle(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1)]
        other = ~same
        parts.append((am[other], a1[other], b0[other], bm[other], spent[other] + 1))
        next_ = [np.concatenate(column) for column in zip(*parts)]
        alive = (next_[1] > next_[0]) & (next_[3] > next_[2]) & (next_[4] <= budget)
        if alive.any():
            stack.append((bit - 1, *(x[alive] for x in next_)))


def _middle(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the given bit becomes one within each sorted range."""
    low, high = low.copy(), high.copy()
    one = np.uint64(1 << bit)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        zero = open_ & ((keys[np.minimum(mid, len(keys) - 1)] & one) == 0)
        low = np.where(zero, mid + 1, low)
        high = np.where(open_ & ~zero, mid, high)


class Forest:
    """Minimum spanning forest over rows, from batches of links."""

    def __init__(self):
        self.i = self.j = self.d = np.empty(0, dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        i, j, d = np.concatenate([self.i, i]), np.concatenate([self.j, j]), np.concatenate([self.d, d])
        nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        u, v = at[:len(i)], at[len(i):]
        order = np.lexsort((v, u, d))
        root, kept = np.arange(len(nodes)), []
        u, v = u[order], v[order]
        while len(order):
            a, b = root[u], root[v]
            apart = a != b
            order, u, v, a, b = order[apart], u[apart], v[apart], a[apart], b[apart]
            if not len(order):
                break
            # Each tree takes its first link in the common order (Boruvka), so that no circle can close.
            first = np.full(len(nodes), len(order), dtype=np.int64)
            np.minimum.at(first, a, np.arange(len(order)))
            np.minimum.at(first, b, np.arange(len(order)))
            taken = np.unique(first[first < len(order)])
            kept.append(order[taken])
            root = _joined(root, a[taken], b[taken])
        pick = np.concatenate(kept).astype(np.int64) if kept else np.empty(0, dtype=np.int64)
        self.i, self.j, self.d = i[pick], j[pick], d[pick]


    def trees(self, n: int) -> np.ndarray:
        """Smallest row of each row's tree."""
        return _joined(np.arange(n), self.i, self.j)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining trees a[k] and b[k]: smallest label along the links, until nothing changes."""
    label = np.arange(len(root))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label[root]
        label = after


def _blocks(prints: DataFrame, n_blocks: int) -> DataFrame:
    """(view, block, value, key, node) for every block of bits of every fingerprint."""
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("key", low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"))
             for k, (low, high) in enumerate(zip(edges, edges[1:]))]
    return prints.select("view", "node", "key", F.explode(F.array(*parts)).alias("b")).select("view", "b.block", "b.value", "key", "node")


def links(prints: DataFrame, n_blocks: int, budget: int) -> DataFrame:
    """(a, b): links between nodes of ``prints`` (view, key, node) that share a block and differ in few bits.

    Keys are signed 64-bit fingerprints; within a view a node has one key. Nodes
    with equal keys are linked too. All rows of a block value go to one task, which
    holds sixteen bytes for each.
    """
    kinds = arrow_schema("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            place, keys, nodes = rows["g"], rows["key"].view(np.uint64), rows["node"]
            order = np.lexsort((keys, place))
            place, keys, nodes = place[order], keys[order], nodes[order]
            # Equal keys of a group are linked in a row, and the first of them stands for all.
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])])
            again = np.flatnonzero(~new)
            copies = (nodes[again - 1], nodes[again])
            place, keys, nodes = place[new], keys[new], nodes[new]
            groups = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            forest, tree = Forest(), np.arange(len(keys))
            for level in [*(x for x in LEVELS if x < budget), budget]:
                waiting, size = [], 0
                for found in trie_links(keys, groups, level, tree):
                    waiting.append(found)
                    size += len(found[0])
                    if size > WALK:
                        forest.add(*map(np.concatenate, zip(*waiting)))
                        waiting, size = [], 0
                if waiting:
                    forest.add(*map(np.concatenate, zip(*waiting)))
                tree = forest.trees(len(keys))
            a, b = np.concatenate([copies[0], nodes[forest.i]]), np.concatenate([copies[1], nodes[forest.j]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=kinds)

        for batch in batches:
            rows = np.empty(batch.num_rows, dtype=[("g", np.int64), ("key", np.int64), ("node", np.int64)])
            for name in rows.dtype.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            held.append(rows)
            if sum(map(len, held)) > WALK // 4:
                # Whole groups leave; the last one may go on in the next batch.
                rows = np.concatenate(held)
                cut = int(np.searchsorted(rows["g"], rows["g"][-1]))
                yield from joined(rows[:cut]) if cut else ()
                held = [rows[cut:]]
        if held:
            yield from joined(np.concatenate(held))

    blocks = _blocks(prints, n_blocks)
    group = F.shiftleft(F.col("view").cast("bigint"), 56).bitwiseOR(F.shiftleft(F.col("block").cast("bigint"), 50)).bitwiseOR(F.col("value"))
    dealt = blocks.select(group.alias("g"), "key", "node").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def crossing(prints: DataFrame, n_blocks: int, budget: int) -> DataFrame:
    """(a, b, crowd): the pairs of nodes of different trees in ``prints`` (view, key, node, tree) that share a block and
    differ in few bits.

    Unlike ``links`` it keeps every pair, for those who measure by something else
    than bits; but where a block value has more than ``CROWDED`` of them for each of
    its rows they aren't listed. Its nodes that have one are a crowd then: rows with
    the crowd's name, the node as a and no b. Rows of a block value are dealt out by
    pairs of parts, so that none but two parts of about ``PART_ROWS`` meet in a task
    or a crowd; values of one tree are left out.
    """
    schema = "a bigint, b bigint, crowd bigint"
    kinds = arrow_schema(schema)
    kind = [("g", np.int64), ("side", np.int64), ("key", np.int64), ("node", np.int64), ("tree", np.int64)]

    def spread(low: np.ndarray, count: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows low[k] and on, count[k] of them, each beside other[k], in batches."""
        ends, at = np.cumsum(count), 0
        while at < len(low):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WALK, "right")))
            n = count[at:to]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(low[at:to], n) + within, np.repeat(other[at:to], n)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def joined(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows = rows[np.lexsort((rows["node"], rows["key"].view(np.uint64), rows["g"]))]
            place, keys = rows["g"], rows["key"].view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])]))
            count = np.diff(np.concatenate([first, [len(rows)]]))
            # A key with nodes of several trees is a tree of its own, which no walk leaves out.
            low, high = np.minimum.reduceat(rows["tree"], first), np.maximum.reduceat(rows["tree"], first)
            tree = np.where(low == high, low, -1 - np.arange(len(first)))
            place, keys = place[first], keys[first]
            groups = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])

            def found():
                mixed = np.flatnonzero(low < high)
                yield mixed, mixed
                for i, j, _ in trie_links(keys, groups, budget, tree):
                    yield i, j

            # Pairs are counted by block value; those of a crowded one are dropped, its nodes with pairs marked.
            begin = np.flatnonzero(np.concatenate([[True], rows["g"][1:] != rows["g"][:-1]]))
            value = np.cumsum(np.concatenate([[0], (rows["g"][1:] != rows["g"][:-1]).astype(np.int64)]))
            most = CROWDED * np.diff(np.concatenate([begin, [len(rows)]]))
            pairs, met, kept = np.zeros(len(begin), dtype=np.int64), np.zeros(len(rows), dtype=bool), []
            for i, j in found():
                for x, other in spread(first[i], count[i], j):
                    for y, x in spread(first[other], count[other], x):
                        r, t = rows[x], rows[y]
                        keep = (r["tree"] != t["tree"]) & ((r["side"] < 0) | (r["side"] != t["side"])) & ((i is not j) | (x < y))
                        x, y = x[keep], y[keep]
                        pairs += np.bincount(value[x], minlength=len(pairs))
                        met[x] = met[y] = True
                        listed = pairs[value[x]] <= most[value[x]]
                        kept.append((x[listed], y[listed]))
            crowded = pairs > most
            for x, y in kept:
                listed = ~crowded[value[x]]
                a, b = rows["node"][x[listed]], rows["node"][y[listed]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], schema=kinds)
            crowd = np.flatnonzero(met & crowded[value])
            if len(crowd):
                yield pa.RecordBatch.from_arrays([pa.array(rows["node"][crowd]), pa.nulls(len(crowd), pa.int64()), pa.array(rows["g"][crowd])], schema=kinds)

        for batch in batches:
            rows = np.empty(batch.num_rows, dtype=kind)
            for name in rows.dtype.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            held.append(rows)
            if sum(map(len, held)) > WALK // 4:
                rows = np.concatenate(held)
                cut = int(np.searchsorted(rows["g"], rows["g"][-1]))
                yield from joined(rows[:cut]) if cut else ()
                held = [rows[cut:]]
        if held and sum(map(len, held)):
            yield from joined(np.concatenate(held))

    blocks = _blocks(prints, n_blocks).join(prints.select("node", "tree").distinct(), "node")
    group = F.shiftleft(F.col("view").cast("bigint"), 56).bitwiseOR(F.shiftleft(F.col("block").cast("bigint"), 50)).bitwiseOR(F.col("value"))
    rows = written(blocks.select(group.alias("g"), "key", "node", "tree"), "blocks")
    several = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("tree").alias("low"), F.max("tree").alias("high")).where("low < high")
    rows = rows.join(several.select("g", F.ceil(F.col("n") / PART_ROWS).alias("parts")), "g")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Two groups of the same hash would only be walked together.
    dealt = rows.select(F.xxhash64("g", F.least("part", "other"), F.greatest("part", "other")).alias("g"),
                        F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part")).alias("side"), "key", "node", "tree")
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema).distinct()


# Components -------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every linked node's component, for (a, b) rows of non-null nodes.

    Large-star and small-star rounds: each node's links move to the smallest node
    around it, until links are stars. Rounds are written; no node's links meet in
    one task but by partial minima and joins that split hot nodes.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(_ROUNDS):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row: a signed 64-bit fingerprint, zero for a text without words or a null one."""
    def make():
        return lambda c: {"doc_id": c["doc_id"], "fp": [signed(fingerprint(shingle_hashes(t or "", shingle))) for t in c["text"]]}
    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, fp bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most ``budget`` bits are linked; component_id is
    the smallest doc_id that can be reached. Equal fingerprints, empty and null
    texts included, are one node whatever their number. Rows with null doc_ids are
    linked too and get the smallest id around them, null if there is none.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select(F.lit(0).alias("view"), F.col("fp").alias("key"), F.col("fp").alias("node")), budget + 1, budget))
    both = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    least = both.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = both.join(least, "root").select("fp", "component")
    labels = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(labels, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


# Documents of a given similarity ------------------------------------------------

#: Independent fingerprints, blocks of each, and differing bits of one fingerprint; at a similarity of 0.8 a pair
#: shares a block and stays in the budget of at least one of sixteen with a probability of 0.98, at 0.9 of more than 0.999.
VIEWS, VIEW_BLOCKS, VIEW_BUDGET = 16, 4, 10
#: What sketches must tell of a pair to have its shingles compared, as a share of the similarity asked for; at 0.8
#: that is 0.7, more than three deviations below.
LOOSE = 0.875
#: Nearest links of a node that are compared first; what they connect isn't compared again.
NEAREST = 4
#: Pairs a block value may have for each of its rows and still have them listed.
CROWDED = 2
#: Rows of a block value that meet in one task when all pairs are wanted; more are dealt out by pairs of parts.
PART_ROWS = 8192
#: Shingles, and a row's own weight in shingles, of documents that are compared in one task.
TILE, ROW_WEIGHT = 1 << 21, 512


def sketch(hashes: np.ndarray, views: int) -> list[int]:
    """Fingerprints of the distinct shingles under ``views`` remixed hashes."""
    distinct = np.unique(hashes)
    steps = spans.mixed(np.arange(1, views + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [signed(fingerprint(spans.mixed(distinct ^ step))) for step in steps]


def _similarity(a: str, b: str, views: int):
    """Jaccard similarity as two sketches tell it: share of differing bits, angle, overlap of the sets."""
    bits = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    overlap = F.cos(bits * (np.pi / (views * BITS))) * F.sqrt(F.col(f"{a}.size") * F.col(f"{b}.size"))
    return overlap / (F.col(f"{a}.size") + F.col(f"{b}.size") - overlap)


def _close(pairs: DataFrame, known: DataFrame, similarity: float, views: int) -> DataFrame:
    """(a, b, told) of the pairs that may reach ``similarity``: by their sizes, and loosely by their sketches."""
    close = pairs.join(known.select(F.col("node").alias("a"), F.struct("size", "sketch").alias("x")), "a")
    close = close.join(known.select(F.col("node").alias("b"), F.struct("size", "sketch").alias("y")), "b")
    fits = F.least("x.size", "y.size") / F.greatest("x.size", "y.size") >= similarity
    return close.where(fits).select("a", "b", _similarity("x", "y", views).alias("told")).where(F.col("told") >= LOOSE * similarity)


def _sets(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the rows (_row, text) that ``nodes`` names: their distinct shingle hashes in order."""
    def make():
        return lambda c: {"node": c["_row"], "shingles": [np.unique(shingle_hashes(t or "", shingle).view(np.int64)) for t in c["text"]]}
    return map_rows(rows.join(nodes.select(F.col("node").alias("_row")), "_row", "left_semi").select("_row", "text"), make, "node bigint, shingles array<bigint>")


def _reaching(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose sets of shingles have at least the Jaccard similarity asked for."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b")


def _nearest(close: DataFrame, count: int) -> DataFrame:
    """The pairs (a, b) that are among the ``count`` of one of their ends that sketches tell nearest."""
    both = close.select("a", "b", "told").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "told"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("told"), "b"))
    return both.withColumn("_rank", rank).where(F.col("_rank") <= count).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(groups: DataFrame, similarity: float, views: int) -> DataFrame:
    """(a, b): links that reach ``similarity`` between the trees of each root in ``groups`` (root, node, tree, size,
    sketch, shingles), as many as connect what such links connect.

    Documents of a root are laid out by tree and cut into tiles of about ``TILE``
    shingles; every two tiles of a root meet in a task, unless both are of one tree.
    """
    order = Window.partitionBy("root").orderBy("tree", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = groups.select("root", "node", "tree", F.floor((F.sum(F.col("size") + ROW_WEIGHT).over(order) - 1) / TILE).alias("tile"))
    places = written(places, "tiles")
    tiles = places.groupBy("root", "tile").agg(F.min("tree").alias("low"), F.max("tree").alias("high"))
    s, t = (tiles.select("root", *[F.col(c).alias(f"{c}_{k}") for c in ("tile", "low", "high")]) for k in "st")
    meet = s.join(t, "root").where("tile_s <= tile_t and not (low_s = high_s and low_t = high_t and low_s = low_t)").select("root", "tile_s", "tile_t")
    sent = meet.withColumn("tile", F.explode(F.array_distinct(F.array("tile_s", "tile_t"))))
    rows = sent.join(places, ["root", "tile"]).join(groups.select("node", "size", "sketch", "shingles"), "node")
    kinds = arrow_schema("a bigint, b bigint")

    def compare(table: pa.Table) -> pa.Table:
        node, label, tile, size = (table.column(c).to_numpy().copy() for c in ("node", "tree", "tile", "size"))
        one = bool((tile == tile[0]).all())
        told = np.array(table.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(-1, views)
        shingles = [x.values.to_numpy() for x in table.column("shingles")]
        out: list[tuple[int, int]] = []
        for i in range(len(node) - 1):
            rest = np.arange(i + 1, len(node))
            rest = rest[(label[rest] != label[i]) & (one | (tile[rest] != tile[i])) & (np.minimum(size[rest], size[i]) / np.maximum(size[rest], size[i]) >= similarity)]
            bits = np.bitwise_count(told[rest] ^ told[i]).sum(1, dtype=np.int64)
            overlap = np.cos(bits * (np.pi / (views * BITS))) * np.sqrt(size[rest] * float(size[i]))
            rest = rest[overlap / (size[rest] + size[i] - overlap) >= LOOSE * similarity]
            if not len(rest):
                continue
            values = np.concatenate([shingles[j] for j in rest])
            at = np.minimum(np.searchsorted(shingles[i], values), len(shingles[i]) - 1)
            shared = np.add.reduceat((shingles[i][at] == values).astype(np.int64), np.cumsum(size[rest]) - size[rest])
            linked = rest[shared / (size[rest] + size[i] - shared) >= similarity]
            out += [(int(node[i]), int(node[j])) for j in linked]
            label[np.isin(label, label[linked])] = label[i]
        return pa.Table.from_arrays([pa.array([x[k] for x in out], type=pa.int64()) for k in (0, 1)], schema=kinds)

    return rows.groupBy("root", "tile_s", "tile_t").applyInArrow(compare, "a bigint, b bigint")


def _within_crowds(crowds: DataFrame, known: DataFrame, trees: DataFrame, similarity: float, views: int) -> DataFrame:
    """(a, b): pairs that may reach ``similarity``, as ``_close`` tells, between trees of each crowd (node, crowd), as many
    as connect what all such pairs connect."""
    rows = crowds.join(known.select("node", "size", "sketch"), "node").join(trees, "node")
    kinds = arrow_schema("a bigint, b bigint")

    def compare(table: pa.Table) -> pa.Table:
        node, label, size = (table.column(c).to_numpy().copy() for c in ("node", "tree", "size"))
        told = np.array(table.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(-1, views)
        a, b = [], []
        for i in range(len(node) - 1):
            rest = np.arange(i + 1, len(node))
            rest = rest[(label[rest] != label[i]) & (np.minimum(size[rest], size[i]) / np.maximum(size[rest], size[i]) >= similarity)]
            bits = np.bitwise_count(told[rest] ^ told[i]).sum(1, dtype=np.int64)
            overlap = np.cos(bits * (np.pi / (views * BITS))) * np.sqrt(size[rest] * float(size[i]))
            rest = rest[overlap / (size[rest] + size[i] - overlap) >= LOOSE * similarity]
            if len(rest):
                # one of each tree will do
                rest = rest[np.unique(label[rest], return_index=True)[1]]
                a += np.minimum(node[rest], node[i]).tolist()
                b += np.maximum(node[rest], node[i]).tolist()
                label[np.isin(label, label[rest])] = label[i]
        return pa.Table.from_arrays([pa.array(x, type=pa.int64()) for x in (a, b)], schema=kinds)

    return rows.groupBy("crowd").applyInArrow(compare, "a bigint, b bigint").distinct()


def _linked(keys: DataFrame, known: DataFrame, rows: DataFrame, shingle: int, similarity: float, views: int) -> DataFrame:
    """(node, root) of nodes that links of ``similarity`` connect.

    The nearest pairs of the forests of every view are compared first. A forest's
    measure is bits of one view, so a link may be missing from it whose ends it
    connects over documents that aren't near enough; what the first links leave
    apart is therefore compared pair by pair.
    """
    pairs = written(links(keys, VIEW_BLOCKS, VIEW_BUDGET), "candidates")
    close = written(_close(pairs, known, similarity, views), "close")
    # A node with a pair within the budget has a link in that block's forest.
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    sets = written(_sets(rows, ends, shingle), "shingles")
    found = components(_reaching(_nearest(close, NEAREST), sets, similarity))
    trees = written(ends.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("tree")), "trees")
    met = written(crossing(keys.join(trees, "node"), VIEW_BLOCKS, VIEW_BUDGET), "crossing")
    few = _close(met.where("crowd IS NULL").select("a", "b").distinct(), known, similarity, views).select("a", "b")
    many = _within_crowds(met.where("crowd IS NOT NULL").select(F.col("a").alias("node"), "crowd"), known, trees, similarity, views)
    rest = written(few.unionByName(many).distinct(), "rest")
    if rest.isEmpty():
        return found
    apart = components(rest)
    apart = apart.unionByName(apart.select(F.col("root").alias("node"), "root").distinct())
    groups = apart.join(trees, "node").join(known, "node").join(sets, "node")
    more = written(_across(groups, similarity, views), "across")
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = VIEWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies: of each group the smallest doc_id stays.

    Two texts are linked if the Jaccard similarity of their sets of lower-cased
    shingles reaches ``similarity``; a group is what links connect. ``views``
    fingerprints of 64 bits only find the pairs whose sets are compared. Texts of equal
    words, repeated rows and texts without words among them, are one group from the
    start. Of equal doc_ids the first row stays; null comes after all others.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")

    def make():
        def work(c):
            out = {k: [] for k in ("w1", "w2", "size", "sketch")}
            for text in c["text"]:
                words = b" ".join((text or "").encode().lower().split())
                hashes = shingle_hashes(text or "", shingle)
                out["w1"].append(signed(xxhash.xxh64_intdigest(words, 1)))
                out["w2"].append(signed(xxhash.xxh64_intdigest(words, 2)))
                out["size"].append(len(np.unique(hashes)))
                out["sketch"].append(sketch(hashes, views))
            return {**{k: c[k] for k in ("_row", "doc_id")}, **out}
        return work

    kind = "_row bigint, doc_id bigint, w1 bigint, w2 bigint, size bigint, sketch array<bigint>"
    prints = written(map_rows(rows.select("_row", "doc_id", "text"), make, kind), "sketches")
    nodes = written(prints.groupBy("w1", "w2").agg(F.min("_row").alias("node"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "nodes")
    keys = nodes.where("size > 0").select(F.posexplode("sketch").alias("view", "key"), "node")
    found = _linked(keys, nodes.select("node", "size", "sketch"), rows, shingle, similarity, views)
    named = prints.select("_row", "doc_id", "w1", "w2").join(nodes.select("w1", "w2", "node"), ["w1", "w2"]).join(found, "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    stay = named.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(order)["_row"].alias("_row")).select("_row")
    return rows.join(stay, "_row", "left_semi").drop("_row").select(*docs.columns)

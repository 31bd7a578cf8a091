"""Operator 11: a Merkle manifest of a table, its leaves placed by bitmap ranks.

Ids of a group become one compressed bitmap: words of 64 ids, of which only those
with a bit are stored, merged from all tasks by OR. A directory of popcounts, a
tree over the words, says how many ids lie before a word, so a leaf's coordinate
is a lookup and a bit count and no table is sorted. Leaves then go into slot
arrays of a fixed size, keyed by group and coordinate; a slot array is reduced by
several levels at once, and the results fill the slot arrays above it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstream.llm.common import arrow_schema, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node of the directory, as a power of two.
BRANCH_BITS = 9
#: Slots of an array at most.
SLOTS = 1024


def digest(*values: Column) -> Column:
    """sha256 in hex of values with their lengths: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _key(group: Column) -> Column:
    """Groups as strings in their order: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


# --- coordinates -----------------------------------------------------------------

def bitmap(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n, repeats) of rows (g, id): bit i of ``bits`` stands for id ``64 * word + i``.

    ``n`` counts rows, ``repeats`` has place and count of ids met more than once.
    Null ids have a word of their own, null, without bits.
    """
    ids = rows.groupBy("g", "id").agg(F.count("*").alias("n"))
    place = F.col("id").bitwiseAND(63)
    return ids.groupBy("g", F.shiftright("id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct(place.cast("int").alias("at"), "n"))).alias("repeats"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with ``before``, the rows of the group before each, and ``total``, all of the group's.

    Built upwards in steps of BRANCH_BITS until a window can hold a whole level, so
    that none holds more nodes than a parent has, and summed downwards. ``words`` is a
    written table, and every level above it becomes one.
    """
    span = words.agg(F.min("word").alias("low"), F.max("word").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    levels = [words.select("g", F.col("word").alias("node"), "n")]
    while high - low >> BRANCH_BITS:
        low, high = low >> BRANCH_BITS, high >> BRANCH_BITS
        level = levels[-1].groupBy("g", F.shiftright("node", BRANCH_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(written(level, "merkle-directory"))
    earlier = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    above = None
    for k, nodes in reversed(list(enumerate(levels))):
        if above is None:
            # the highest level, and the word of null ids, which comes first
            whole = Window.partitionBy("g")
            summed = nodes.select("g", "node", F.coalesce(F.sum("n").over(earlier.partitionBy("g")), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
        else:
            own = nodes.withColumn("parent", F.shiftright("node", BRANCH_BITS))
            own = own.withColumn("own", F.coalesce(F.sum("n").over(earlier.partitionBy("g", "parent")), F.lit(0)))
            own, up = own.alias("own"), above.alias("up")
            summed = own.join(up, (F.col("own.g") == F.col("up.g")) & F.col("own.parent").eqNullSafe(F.col("up.node"))).select(
                "own.g", "own.node", (F.col("up.before") + F.col("own.own")).alias("before"), "up.total")
        above = written(summed, "merkle-directory") if k else summed
    left, right = words.alias("w"), above.alias("d")
    return left.join(right, (F.col("w.g") == F.col("d.g")) & F.col("w.word").eqNullSafe(F.col("d.node"))).select("w.*", "d.before", "d.total")


def positions(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``idx`` and ``total``: their place among those equal in ``by`` when ordered, and how many these are.

    Ranges of the order are counted and the counts summed up, so a large group is
    spread over tasks. ``rows`` must be a written table whose order has no ties.
    """
    cut = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "merkle-ranges")
    counts = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    span = Window.partitionBy(*by)
    counts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(span.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_n").over(span).alias("total"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    left, right = cut.withColumn("_own", own).alias("l"), counts.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(*[f"l.{c}" for c in rows.columns], (F.col("_before") + F.col("_own")).alias("idx"), "r.total")


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, leaf, ...), a written table, with ``idx``, the leaf's place in its group, and ``total``.

    Rows with an id of their own are placed by rank queries. Rows that share an id,
    or have none, are ordered by leaf behind the rows before them; equal leaves
    take neighbouring places.
    """
    words = written(directory(written(bitmap(rows), "merkle-bitmap")), "merkle-words")
    joined = rows.withColumn("_w", F.shiftright("id", 6)).alias("r").join(
        words.select(F.col("g").alias("_g"), "word", "bits", "repeats", "before", "total").alias("w"), (F.col("r.g") == F.col("_g")) & F.col("_w").eqNullSafe(F.col("word")))
    at = F.expr("CAST(id & 63 AS INT)")
    smaller = F.expr("bit_count(bits & ~shiftleft(-1L, CAST(id & 63 AS INT)))")
    repeated = F.aggregate(F.filter("repeats", lambda x: x["at"] < at), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] - 1)
    joined = joined.withColumn("_rank", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("before") + smaller + repeated))
    shared = F.col("id").isNull() | F.exists("repeats", lambda x: x["at"] == at)
    own = [*rows.columns]
    placed = joined.where(~shared).select(*own, F.col("_rank").alias("idx"), "total")
    if words.where((F.size("repeats") > 0) | F.col("word").isNull()).isEmpty():
        return placed
    tied = joined.where(shared).select(*own, F.col("_rank"), F.col("total").alias("_total"), F.monotonically_increasing_id().alias("_row"))
    tied = positions(written(tied, "merkle-ties"), ["leaf", "_row"], ["g", "id"])
    return placed.unionByName(tied.select(*own, (F.col("_rank") + F.col("idx")).alias("idx"), F.col("_total").alias("total")))


# --- slot arrays -----------------------------------------------------------------

def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(slots: list[str], total: int, fanout: int, steps: int) -> list[list[str]]:
    """The levels over a slot array: up to its top where it is the group's only one, else ``steps`` of them."""
    levels = [slots]
    while len(levels[-1]) > 1 if total <= fanout ** steps else len(levels) <= steps:
        last = levels[-1]
        levels.append([joined_digest(last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def _filled(table: pa.Table) -> list[str]:
    slots: list = [None] * table.num_rows
    for slot, value in zip(table.column("slot").to_pylist(), table.column("digest").to_pylist()):
        slots[slot] = value
    return slots


def _per_block(total: Column, size: int) -> Column:
    return F.expr(f"(total + {size - 1}) DIV {size}")


class SlotTree:
    """Trees over nodes (g, idx, total, digest), one for each g, several levels a round."""

    def __init__(self, fanout: int):
        self.fanout, self.steps = fanout, 1
        while fanout ** (self.steps + 1) <= SLOTS:
            self.steps += 1
        self.size = fanout ** self.steps

    def _slotted(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumns({"block": F.expr(f"idx DIV {self.size}"), "slot": (F.col("idx") % self.size).cast("int")})

    def rounds(self, nodes: DataFrame) -> list[DataFrame]:
        """Written tables of nodes, from ``nodes`` (written) to one node for each g."""
        fanout, steps, size = self.fanout, self.steps, self.size
        out, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
        schema = "g string, idx bigint, total bigint, digest string"
        kinds = arrow_schema(schema)

        def reduce(key, table):
            total = key[2].as_py()
            top = levels_of(_filled(table), total, fanout, steps)[-1][0]
            return pa.Table.from_pylist([{"g": key[0].as_py(), "idx": key[1].as_py(), "total": -(-total // size), "digest": top}], schema=kinds)

        while most > 1:
            slotted = self._slotted(out[-1]).select("g", "block", "total", "slot", "digest")
            out.append(written(slotted.groupBy("g", "block", "total").applyInArrow(reduce, schema), "merkle-level"))
            most = -(-most // size)
        return out

    def paths(self, nodes: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
        """``nodes`` with the paths from them to the root: ``above`` has those of their blocks.

        ``above``: (g, idx, lefts, rights, subroot, root). A path has, level by level,
        the digests to the left and to the right of the run's member on it.
        """
        fanout, steps = self.fanout, self.steps
        slotted = self._slotted(nodes)
        rest = [c for c in ["g", "idx", "digest", *carry]]
        kind = dict(nodes.dtypes)
        schema = ", ".join(f"`{c}` {kind[c]}" for c in rest) + ", lefts array<string>, rights array<string>, subroot string, root string"
        kinds = arrow_schema(schema)

        def descend(key, table, up):
            if not table.num_rows:
                return kinds.empty_table()
            slots = _filled(table)
            levels = levels_of(slots, table.column("total")[0].as_py(), fanout, steps)[:-1]
            up_lefts, up_rights = up.column("lefts")[0].as_py(), up.column("rights")[0].as_py()
            # what lies beside each member of each level is joined once
            beside = []
            for level in levels:
                left, right = [], []
                for i in range(len(level)):
                    run = i - i % fanout
                    left.append("".join(level[run:i]))
                    right.append("".join(level[i + 1:run + fanout]))
                beside.append((left, right))
            lefts, rights = [], []
            for slot in table.column("slot").to_pylist():
                mine, other = [], []
                for left, right in beside:
                    mine.append(left[slot])
                    other.append(right[slot])
                    slot //= fanout
                lefts.append(mine + up_lefts)
                rights.append(other + up_rights)
            n = table.num_rows
            arrays = [table.column(c).combine_chunks() for c in rest]
            arrays += [pa.array(lefts, kinds.field("lefts").type), pa.array(rights, kinds.field("rights").type)]
            arrays += [pa.array([up.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
            return pa.Table.from_arrays([pa.chunked_array([a]) if not isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=kinds)

        blocks = above.withColumnRenamed("idx", "block")
        return slotted.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(descend, schema)


# --- the manifest ----------------------------------------------------------------

def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, carried columns, lefts, rights, subroot, root): one row for each row, with its proof.

    A leaf is the digest of ``fields``. A group's leaves stand in the order of the
    whole-number ``id``, null ids first; of rows with equal ids those with the
    smaller leaf come first, and equal rows take neighbouring places. ``fanout``
    neighbours become one node, level by level; groups, null first, make the tree
    above them in the same way. ``carry`` adds columns computed from the rows.
    Other columns of any name are ignored. No rows give no rows.
    """
    spark, carry = docs.sparkSession, carry or {}
    rows = docs.select(F.col(id).cast("bigint").alias("id"), _key(F.col(group)).alias("g"), digest(*[F.col(f) for f in fields]).alias("leaf"),
                       *[c.alias(f"carry_{name}") for name, c in carry.items()])
    rows = written(rows, "merkle-leaves")
    carried = ["id", *[f"carry_{name}" for name in carry]]
    leaves = written(coordinates(rows).withColumnRenamed("leaf", "digest"), "merkle-slots")
    tree = SlotTree(fanout)
    rounds = tree.rounds(leaves)
    # Subroots are the leaves of the tree of groups.
    groups = positions(rounds[-1].select("g", F.col("digest").alias("subroot")), ["g"], [])
    tops = tree.rounds(written(groups.select(F.lit("").alias("g"), "idx", "total", F.col("subroot").alias("digest"), F.col("g").alias("of")), "merkle-subroots"))
    none = F.array().cast("array<string>")
    above = tops[-1].select("g", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for k, nodes in reversed(list(enumerate(tops[:-1] or tops))):
        above = tree.paths(nodes, above, ["of"] if k == 0 else [])
    above = above.select(F.col("of").alias("g"), F.lit(0).cast("bigint").alias("idx"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    for k, nodes in reversed(list(enumerate(rounds[:-1] or rounds))):
        above = tree.paths(nodes, above, carried if k == 0 else [])
    return above.select(F.col("id").alias(id), F.col("digest").alias("leaf"), *[F.col(f"carry_{name}").alias(name) for name in carry], "lefts", "rights", "subroot", "root")


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its path lead to."""
    steps = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the manifest of ``docs``.

    Where 7 divides the crc32 of a doc_id in decimal, the row is tampered with
    before it is verified: 1 is added to ``n_chars``. A null doc_id or ``n_chars``
    is left alone. Proofs are of the rows as they were.
    """
    more = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    changed = digest(*[more.get(f, F.col(f)) for f in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = manifest(docs, carry={"presented": F.when(hit, changed)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("presented", "leaf"), F.col("lefts"), F.col("rights")))
    beside = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_VALUE.format(f) for f in FIELDS)
_TAMPERED = " || ".join(_VALUE.format("(n_chars::HUGEINT + hit::INT)" if f == "n_chars" else f) for f in FIELDS)

#: The same in DuckDB: every level of a group is a list. crc32, which DuckDB lacks, is taken bit by bit.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS place, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, place + 1, list_reduce(list_prepend(xor(c, ascii(s[place + 1])::BIGINT), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
  FROM crc WHERE place < length(s)),
hits AS (SELECT doc_id, xor(c, 4294967295) % 7 = 0 AS hit FROM crc WHERE place = length(s)),
marked AS (SELECT d.*, coalesce(hit, false) AS hit FROM documents d LEFT JOIN hits USING (doc_id)),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({_LEAF}) AS leaf, sha256({_TAMPERED}) AS presented FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
levels AS (
  SELECT g, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM placed GROUP BY g
  UNION ALL
  SELECT g, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(g)) - 1 AS idx FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY idx) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM tops WHERE len(nodes) > 1),
walk AS (
  SELECT p.doc_id, p.g, p.leaf, p.idx AS first, 0 AS step, p.idx AS idx, presented AS node, '' AS beside, false AS done FROM placed p
  UNION ALL
  SELECT doc_id, g, leaf, first, step + 1, place // 2, sha256(CASE WHEN place % 2 = 0 THEN node || other ELSE other || node END), beside || other, done
  FROM (SELECT w.*, CASE WHEN step < s.height THEN w.idx WHEN step = s.height THEN s.idx ELSE w.idx END AS place,
               coalesce(CASE WHEN step < s.height THEN l.nodes ELSE t.nodes END[xor(CASE WHEN step = s.height THEN s.idx ELSE w.idx END, 1) + 1], '') AS other
        FROM walk w JOIN subroots s ON w.g = s.g LEFT JOIN levels l ON l.g = w.g AND l.level = w.step AND step < s.height LEFT JOIN tops t ON t.level = w.step - s.height
        WHERE step < s.height + (SELECT max(level) FROM tops)))
SELECT w.doc_id, w.leaf, s.subroot, r.nodes[1] AS root, sha256(w.beside) AS proof_sha256, w.node AS folded_root, w.node = r.nodes[1] AS verified
FROM walk w JOIN subroots s ON w.g = s.g CROSS JOIN (SELECT nodes FROM tops WHERE len(nodes) = 1) r
WHERE w.step = s.height + (SELECT max(level) FROM tops)"""

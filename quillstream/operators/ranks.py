"""Selection by rank, over keys of any orderable type.

Where the n-th row of a group lies is found on a narrow table of keys, stored
once: a uniform sample, which merges like any top-k, gives bounds of even ranges,
the ranges are counted, the counts are summed up within each group, and only the
range that holds the n-th row is looked into. Ranges that are too long to be
ranked in one task are cut again. Rows themselves are never moved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from quillstream.session import stored

#: Keys in the sample, which the driver sees, and bounds taken from it.
SAMPLE = 4096
BOUNDS = 63
#: Rows of a range that one task may rank.
RANKED = 1 << 20
#: Rows of a page whose keys one task may list; a longer page is cut out between two keys.
LISTED = 1 << 12


@dataclass(frozen=True)
class By:
    """A column of an order; as in Spark, nulls are the smallest."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)


def by(*names: str, descending: bool = False) -> list[By]:
    return [By(n, descending) for n in names]


def precedes(left: list[Column], right: list[Column], order: list[By]) -> Column:
    """Whether a key comes before another one; never null."""
    out = F.lit(False)
    for a, b, o in reversed(list(zip(left, right, order))):
        if o.descending:
            a, b = b, a
        smaller = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
        out = smaller | (a.eqNullSafe(b) & out)
    return out


def same(left: list[Column], right: list[Column]) -> Column:
    return reduce(and_, [a.eqNullSafe(b) for a, b in zip(left, right)], F.lit(True))


def _cutting(group: list[str], order: list[By]) -> tuple[list[By], bool]:
    """Columns by which ranges are cut, all in one direction: groups, and the order up to where its direction turns."""
    down = order[0].descending
    turn = next((i for i, o in enumerate(order) if o.descending != down), len(order))
    return [*by(*group, descending=down), *order[:turn]], down


def _bounds(keys: DataFrame, cutting: list[By]) -> list[Row]:
    """Distinct keys that cut a sample into even parts, in order."""
    # Random order is a sample that every task can merge; sorted by Spark, as types decide.
    sample = keys.select(*[o.name for o in cutting]).orderBy(F.rand(7)).limit(SAMPLE).orderBy(*[o.column() for o in cutting]).collect()
    step = max(1, len(sample) // (BOUNDS + 1))
    return list(dict.fromkeys(sample[step::step]))


def _range_of(keys: DataFrame, cutting: list[By], down: bool, bounds: list[Row]) -> Column:
    """Number of bounds that do not come after a key, by bisection: a balanced tree of comparisons.

    Structs compare field by field with nulls first, as orders do.
    """
    own = F.struct(*[o.name for o in cutting])

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*[F.lit(bounds[middle][o.name]).cast(keys.schema[o.name].dataType).alias(o.name) for o in cutting])
        return F.when(own > bound if down else own < bound, tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def nth_keys(keys: DataFrame, group: list[str], order: list[By], n: int) -> DataFrame:
    """For each group of ``n`` rows or more: the key of its n-th row.

    Columns are those of ``group`` and ``order``, ``take``, how many rows with that
    key are among the first n, and ``copies``, how many there are. ``keys`` is a
    stored table with the columns of ``group`` and ``order``, nulls included.
    """
    cutting, down = _cutting(group, order)
    names = [*group, *[o.name for o in order]]
    own = [F.col(c) for c in names]
    rows = keys.select(*own).withColumn("_n", F.lit(n).cast("bigint"))
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most, before = keys.count(), None
    while True:
        cut = rows.withColumn("_range", _range_of(keys, cutting, down, _bounds(rows, cutting)))
        ends = [f(F.struct(*[o.name for o in order])).alias(name) for f, name in ((F.min, "_from"), (F.max, "_to"))]
        sizes = cut.groupBy(*group, "_range").agg(F.count("*").alias("_size"), F.max("_n").alias("_n"), *ends)
        summed = sizes.withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
        edge = summed.where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_size") >= F.col("_n")))
        edge = edge.select(*[F.col(g).alias(f"{g}_") for g in group], F.col("_range").alias("_edge"), (F.col("_n") - F.col("_before")).alias("_rest"), "_size", "_from", "_to")
        if most > RANKED:
            # only then can a range be too long; one of equal keys needs no ranking and can't be cut
            edge = stored(edge, "ranks-edge")
            before, most = most, edge.where(~F.col("_from").eqNullSafe(F.col("_to"))).agg(F.max("_size")).first()[0] or 0
        inside = same([F.col(g) for g in [*group, "_range"]], [F.col(g) for g in [*[f"{g}_" for g in group], "_edge"]])
        rows = cut.join(edge, inside).select(*own, F.col("_rest").alias("_n"))
        # a range that bounds no longer cut holds few keys, of many copies
        if most <= RANKED or most == before:
            break
        rows = stored(rows, "ranks-rows")
    # equal keys are counted first, so that copies of one key are never ranked
    counted = rows.groupBy(*names).agg(F.count("*").alias("copies"), F.max("_n").alias("_n"))
    upto = Window.partitionBy(*group).orderBy(*[o.column() for o in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_before", F.sum("copies").over(upto) - F.col("copies"))
    hit = placed.where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("copies") >= F.col("_n")))
    return hit.select(*own, (F.col("_n") - F.col("_before")).alias("take"), "copies")


def _of(side: str, names: list[str]) -> list[Column]:
    return [F.col(f"{side}.`{c}`").alias(c) for c in names]


def first_n(df: DataFrame, group: list[str], order: list[By], n: int) -> DataFrame:
    """First ``n`` rows of each group, whatever n: rows up to the group's n-th key.

    The input is read twice, once for its keys. Only where more rows share the last
    key than are wanted are they read again, to be numbered by their content.
    """
    if n < 1:
        return df.limit(0)
    names, at = [*group, *[o.name for o in order]], [o.name for o in order]
    nth = stored(nth_keys(stored(df.select(*names), "ranks-keys"), group, order, n), "ranks-nth")
    joined = df.alias("rows").join(nth.alias("nth"), same(_of("rows", group), _of("nth", group)), "left")
    key, last, take = _of("rows", at), _of("nth", at), F.col("nth.take")
    # groups without an n-th row are kept whole
    inside = take.isNull() | precedes(key, last, order)
    at_last = take.isNotNull() & same(key, last)
    split = take < F.col("nth.copies")
    kept = joined.where(inside | (at_last & ~split)).select(*_of("rows", df.columns))
    if nth.where("take < copies").isEmpty():
        return kept
    row = F.struct(*_of("rows", df.columns))
    number = F.row_number().over(Window.partitionBy(*_of("rows", group)).orderBy(F.xxhash64(row)))
    tied = joined.where(at_last & split).select(row.alias("row"), (number <= take).alias("wanted"))
    return kept.unionByName(tied.where("wanted").select("row.*"))


def _between(df: DataFrame, order: list[By], start: Row | None, end: Row | None) -> DataFrame:
    """Rows behind ``start`` up to ``end``, in order; each a row of ``nth_keys``, or None for the first and the last row there is.

    No task meets more of them than a range of a distributed sort, but for rows that share a bound that is split.
    """
    key = [F.col(o.name) for o in order]
    inside, split = F.lit(True), F.lit(False)
    wanted = F.lit(True)
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.struct(*df.columns))))
    if start is not None:
        first = [F.lit(start[o.name]).cast(df.schema[o.name].dataType) for o in order]
        inside = inside & precedes(first, key, order)
        if start["take"] < start["copies"]:
            split = split | same(first, key)
            wanted = wanted & (~same(first, key) | (number > start["take"]))
    if end is not None:
        last = [F.lit(end[o.name]).cast(df.schema[o.name].dataType) for o in order]
        whole = end["take"] == end["copies"]
        inside = inside & (precedes(key, last, order) | same(key, last) if whole else precedes(key, last, order))
        if not whole:
            split = split | same(key, last)
            wanted = wanted & (~same(key, last) | (number <= end["take"]))
        elif start is not None and all(start[o.name] == end[o.name] for o in order):
            split, inside = same(key, last), F.lit(False)
    rows = df.where(inside)
    if (start is not None and start["take"] < start["copies"]) or (end is not None and end["take"] < end["copies"]):
        rows = rows.unionByName(df.where(split).withColumn("_wanted", wanted).where("_wanted").drop("_wanted"))
    return rows.orderBy(*[o.column() for o in order])


def page(df: DataFrame, order: list[By], offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` in order, located on their keys; two reads of ``df``, three at a shared bound of a long page.

    Rows with equal keys are told apart by their content, so that pages neither
    lose nor repeat one.
    """
    names = [o.name for o in order]
    keys = stored(df.select(*names), "ranks-keys")
    key = [F.col(c) for c in names]
    beyond = keys.withColumn("_skip", F.lit(0).cast("bigint"))
    start = nth_keys(keys, [], order, offset).first() if offset else None
    if offset and start is None:
        return df.limit(0)
    if limit > LISTED:
        return _between(df, order, start, nth_keys(keys, [], order, offset + limit).first())
    if offset:
        last = [F.lit(start[o.name]).cast(keys.schema[o.name].dataType) for o in order]
        beyond = keys.where(precedes(last, key, order) | same(key, last)).withColumn("_skip", F.when(same(key, last), F.lit(start["take"])).otherwise(F.lit(0)).cast("bigint"))
    counted = beyond.groupBy(*names).agg(F.count("*").alias("_copies"), F.max("_skip").alias("_skip")).where(F.col("_copies") > F.col("_skip"))
    # at most ``limit`` keys hold the page
    first = counted.orderBy(*[o.column() for o in order]).limit(limit)
    upto = Window.orderBy(*[o.column() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("_copies") - F.col("_skip")).over(upto), F.lit(0))
    first = first.withColumn("_before", before).where(F.col("_before") < limit)
    wanted = first.select(*names, F.col("_copies").alias("copies"), F.col("_skip").alias("skip"), F.least(F.col("_copies"), F.col("_skip") + limit - F.col("_before")).alias("upto"))
    wanted = stored(wanted, "ranks-page")
    joined = df.alias("rows").join(wanted.alias("wanted"), same(_of("rows", names), _of("wanted", names)))
    if wanted.where("copies > 1").isEmpty():
        rows = joined.select(*_of("rows", df.columns))
    else:
        row = F.struct(*_of("rows", df.columns))
        number = F.row_number().over(Window.partitionBy(*_of("rows", names)).orderBy(F.xxhash64(row)))
        rows = joined.select(row.alias("row"), ((number > F.col("wanted.skip")) & (number <= F.col("wanted.upto"))).alias("wanted")).where("wanted").select("row.*")
    return rows.orderBy(*[o.column() for o in order])

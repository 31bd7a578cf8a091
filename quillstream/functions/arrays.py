"""Small array helpers that stay inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression.

    A lambda body re-evaluates an outer expression per element; binding it as a
    lambda variable of a one-element transform computes it once per row.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element of each key, in order. O(n log n) per row."""

    def keep_first(entries: Column) -> Column:
        kept = F.filter(
            entries,
            lambda e, i: (i == 0) | (F.get(entries, i - 1)["key"] != e["key"]),
        )
        in_order = F.sort_array(
            F.transform(kept, lambda e: F.struct(e["pos"].alias("pos"), e["item"].alias("item")))
        )
        return F.transform(in_order, lambda e: e["item"])

    tagged = F.transform(
        values,
        lambda x, i: F.struct(key(x).alias("key"), i.alias("pos"), x.alias("item")),
    )
    return bind(F.sort_array(tagged), keep_first)


def run_lengths(sorted_items: Column) -> Column:
    """``[(neg_count, item)]`` of a sorted array, one entry per distinct item."""

    def runs(items: Column) -> Column:
        n = F.size(items)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1)),
        )
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda at, j: F.struct(
                    (at - F.coalesce(F.get(s, j + 1), n)).alias("neg_count"),
                    F.get(items, at).alias("item"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<neg_count:int,item:string>>")
    return bind(
        sorted_items,
        lambda items: F.when(F.size(items) > 0, runs(items)).otherwise(empty),
    )

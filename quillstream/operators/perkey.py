"""First, last and first-n rows per key, safe for keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstream.operators.ranks import by, first_n

# Catalyst pre-limits each map task for ranks up to this bound
# (spark.sql.optimizer.windowGroupLimitThreshold), so a hot group never reaches
# one task whole.
GROUP_LIMIT_BOUND = 1000


def _pick(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row of each key. ``min_by`` combines on the map side: one row per
    key and task is shuffled, whatever the skew."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key, combined on the map side."""
    return _pick(df, keys, order, F.max_by)


def first_n_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each group by ``order``, columns of any orderable type.

    Small ``n`` is a rank filter that Catalyst pre-limits per map task. For a
    large ``n`` that would still send ``n`` rows per task and group to one
    reducer, so the key of each group's n-th row is found first and rows are
    compared with it where they are.
    """
    if n <= GROUP_LIMIT_BOUND:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return first_n(df, [group], by(*order), n)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus the new keys not among them; nothing is ever removed.

    ``new`` is reduced to one row per key first, so a key repeated in the batch
    costs one shuffled row per map task.
    """
    fresh = new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def any_differs(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(False)
    for a, b in zip(left, right):
        out = out | ~a.eqNullSafe(b)
    return out

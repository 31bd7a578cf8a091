"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Parts a heavy key's rows are dealt out to; a key is heavy from one such part of all rows.
SALTS = 64
#: Items the sketch keeps; its error is about rows over this number.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, salts: int = SALTS) -> Column:
    """Array of the keys that hold a ``1 / salts`` of the rows or more, as a scalar subquery.

    Found by a frequent-items sketch, which tasks merge: no key above the share is
    missed, a key just below may be named too. Fewer than ``2 * salts`` keys.
    """
    estimate = F.expr(f"approx_top_k(`{key}`, {2 * salts}, {TRACKED})")
    found = df.where(F.col(key).isNotNull()).agg(F.struct(estimate.alias("top"), F.count("*").alias("n")).alias("v"))
    # the estimate may be low by the sketch's error, a quarter of the share at most
    heavy = found.select(F.transform(F.filter("v.top", lambda t: t["count"] * salts * 4 >= F.col("v.n") * 3), lambda t: t["item"]).alias("keys"))
    return heavy.scalar()


def salted_join(left: DataFrame, right: DataFrame, key: str, other: str, salts: int = SALTS) -> DataFrame:
    """``left`` left outer joined with ``right`` on ``left.key = right.other``; ``right`` has one row for each key.

    Rows of a heavy key are dealt out to ``salts`` parts, each with a copy of that
    key's row; all other rows and keys are joined as they are.
    """
    heavy = F.coalesce(heavy_keys(left, key, salts), F.array().cast("array<string>"))
    dealt = F.when(F.array_contains(heavy, F.col(key)), (F.monotonically_increasing_id() % salts).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.array_contains(heavy, F.col(other)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    rows = left.withColumn("_salt", dealt)
    spread = right.withColumn("_copy", F.explode(copies))
    return rows.join(spread, (F.col(key) == F.col(other)) & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy")

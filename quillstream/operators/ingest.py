"""Messages to tables: parse, filter, quarantine, upsert, ledger, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstream import lexicon
from quillstream.functions import wire
from quillstream.functions.text import collation_key, fold_key, is_blank
from quillstream.operators.perkey import any_differs, first_per_key, last_per_key
from quillstream.schemas import LIST_FIELDS, PAPER_EVENT, PAPER_PAYLOAD

YEARLY = "yearly"
# 2 to this power registers a sketch: a standard error of 0.65 %.
SKETCH_BITS = 14
EVENT_COLUMNS = [f.name for f in PAPER_EVENT.fields]


def parse_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed record columns plus ``reason``, set for text that is not JSON.

    All other columns of ``messages`` are kept. The parse sits behind a generator
    so that later filters are not pushed below it, which would parse twice.
    """
    text = F.col(value)
    raw = messages.select("*", F.explode(F.array(wire.raw_fields(text))).alias("_raw"))
    reason = F.when(wire.malformed(text, F.col("_raw")), "malformed").alias("reason")
    return raw.select(*messages.columns, *wire.event_columns(text, F.col("_raw")), reason)


def check_lengths(parsed: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Set ``reason`` on records a stored column could not hold."""
    reason = F.col("reason")
    for name, limit in (lexicon.MAX_LENGTHS if limits is None else limits).items():
        if name in LIST_FIELDS:
            over = F.exists(name, lambda x: F.length(x) > limit)  # noqa: B023 - used at once
        else:
            over = F.length(name) > limit
        reason = F.coalesce(reason, F.when(over, F.lit(f"too long: {name}")))
    return parsed.withColumn("reason", reason)


def valid_events(parsed: DataFrame) -> DataFrame:
    """Records with a non-blank id and title."""
    keep = F.col("reason").isNull() & ~is_blank(F.col("source_id")) & ~is_blank(F.col("title"))
    return parsed.where(keep).drop("reason")


def quarantined(parsed: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Records kept aside with their reason; ``fail_fast`` raises on the first one."""
    bad = parsed.where(F.col("reason").isNotNull())
    if fail_fast:
        return bad.withColumn("reason", F.raise_error(F.concat(F.lit("bad message: "), "reason")).cast("string"))
    return bad


def first_events(events: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    return first_per_key(events, [key], [order])


def latest_events(events: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    return last_per_key(events, [key], [order])


def dimension_rows(events: DataFrame, field: str, key: str = "source_id", collation: str | None = None,
                   order: str = "seq") -> DataFrame:
    """Distinct ``(key, value)`` of a list column, blanks dropped.

    With a collation the first stored spelling represents its group.
    """
    kept = [key] + ([order] if collation else [])
    rows = events.select(*kept, F.explode(field).alias("value")).where(~is_blank(F.col("value")))
    if not collation:
        return rows.distinct()
    spellings = rows.groupBy(key, "value").agg(F.min(order).alias(order))
    return (
        spellings.groupBy(fold_key(F.col(key), collation).alias("_key"), fold_key(F.col("value"), collation).alias("_value"))
        .agg(F.min_by(key, order).alias(key), F.min_by("value", order).alias("value"))
        .select(key, "value")
    )


def keyed_dimension(events: DataFrame, field: str, key: str = "source_id", order: str = "seq") -> DataFrame:
    """``(key_key, value_key, key, value, first_seq)``: distinct pairs by collation key, with the spelling that arrived first.

    Keys are plain strings stored beside the spelling, so joins and unions on them
    need no collation.
    """
    rows = events.select(F.col(key), F.col(order), F.posexplode(field).alias("_pos", "value")).where(~is_blank(F.col("value")))
    keys = [collation_key(F.col(key)).alias(f"{key}_key"), collation_key(F.col("value")).alias("value_key")]
    first = F.struct(F.col(order), F.col("_pos"))
    return rows.groupBy(*keys).agg(F.min_by(key, first).alias(key), F.min_by("value", first).alias("value"), F.min(order).alias("first_seq"))


def keyed_deltas(firsts: DataFrame, field: str, order: str = "seq") -> DataFrame:
    """``(value_key, value, first_seq, paper_count)``: increments by collation key.

    Lists are distinct by spelling only, so two spellings of a value in one record
    are two increments of one counter, though one row of the dimension.
    """
    rows = firsts.select(F.col(order), F.posexplode(field).alias("_pos", "value")).where(~is_blank(F.col("value")))
    return rows.groupBy(collation_key(F.col("value")).alias("value_key")).agg(
        F.min_by("value", F.struct(F.col(order), F.col("_pos"))).alias("value"), F.min(order).alias("first_seq"), F.count("*").alias("paper_count"))


def first_events_keyed(events: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    """First event of each id by collation key, which is kept as ``<key>_key``."""
    return first_per_key(events.withColumn(f"{key}_key", collation_key(F.col(key))), [f"{key}_key"], [order])


def merge_keyed(stored: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key columns: the spelling that arrived first stays, counts are summed; no join."""
    spelled = [c for c in stored.columns if c not in (*keys, "first_seq", "paper_count")]
    sums = [F.sum("paper_count").alias("paper_count")] if "paper_count" in stored.columns else []
    merged = stored.unionByName(delta.select(*stored.columns)).groupBy(*keys).agg(
        *[F.min_by(c, "first_seq").alias(c) for c in spelled], F.min("first_seq").alias("first_seq"), *sums)
    return merged.select(*stored.columns)


def sketches(dimensions: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(name, sketch)``: distinct-count sketches of a batch, to be united by readers. Keywords leave stopwords out.

    A sketch takes repeated values as one, so rows of ``dimensions`` may repeat, and
    each task makes its own: only sketches are shuffled.
    """
    kept = (F.col("dimension") != "keywords") | ~F.lower("value").isin(lexicon.STOPWORDS)
    values = dimensions.where(kept).select(F.col("dimension").alias("name"), "value")
    values = values.unionByName(firsts.select(F.explode(F.array(
        F.struct(F.lit("papers").alias("name"), F.col("source_id").alias("value")),
        F.struct(F.lit("years").alias("name"), F.col("year").cast("string").alias("value")))).alias("v")).select("v.*"))
    return values.groupBy("name").agg(F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch"))


def year_deltas(firsts: DataFrame) -> DataFrame:
    return firsts.groupBy("year").agg(F.count("*").alias("paper_count"))


def value_deltas(firsts: DataFrame, field: str, collation: str | None = None) -> DataFrame:
    """One increment per listed value of each first-seen record."""
    values = firsts.select(F.explode(field).alias("value")).where(~is_blank(F.col("value")))
    spellings = values.groupBy("value").agg(F.count("*").alias("paper_count"))
    if not collation:
        return spellings
    return (
        spellings.groupBy(fold_key(F.col("value"), collation).alias("_key"))
        .agg(F.min("value").alias("value"), F.sum("paper_count").alias("paper_count"))
        .select("value", "paper_count")
    )


def all_dimension_rows(events: DataFrame, key: str = "source_id") -> DataFrame:
    """Distinct ``(dimension, key, value)`` of all list columns, in one shuffle."""
    return listed_values(events, [key]).distinct()


def listed_values(events: DataFrame, keys: list[str]) -> DataFrame:
    """``(dimension, *keys, value)`` of all list columns, repeats included, blanks dropped."""
    tagged = F.flatten(F.array(*[_tagged(name, F.col(name)) for name in LIST_FIELDS]))
    rows = events.select(*keys, F.explode(tagged).alias("_t"))
    return rows.select(F.col("_t.tag").alias("dimension"), *keys, F.col("_t.value").alias("value")).where(~is_blank(F.col("value")))


def all_deltas(firsts: DataFrame) -> DataFrame:
    """Increments of the four counters as ``(counter, value, paper_count)``, in one shuffle."""
    year = F.array(F.col("year").cast("string"))
    tagged = F.flatten(F.array(_tagged(YEARLY, year), *[_tagged(name, F.col(name)) for name in LIST_FIELDS]))
    rows = firsts.select(F.explode(tagged).alias("_t"))
    listed = rows.select(F.col("_t.tag").alias("counter"), F.col("_t.value").alias("value")).where(~is_blank(F.col("value")))
    return listed.groupBy("counter", "value").agg(F.count("*").alias("paper_count"))


def _tagged(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("tag"), v.alias("value")))


def merge_counters(stored: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Stored counters plus increments: a union summed per key, no join."""
    return (
        stored.select(key, "paper_count")
        .unionByName(delta.select(key, "paper_count"))
        .groupBy(key)
        .agg(F.sum("paper_count").alias("paper_count"))
    )


def upsert_merge(stored: DataFrame, batch: DataFrame, now: Column, payload: list[str] | None = None,
                 key: str = "source_id") -> DataFrame:
    """Last write wins on ``payload``; ``created_at`` and ``id`` stay, ``updated_at``
    moves only when a value changed.

    Both sides hold one row per key, so the outer join meets no hot key.
    ``stored`` has id, key, payload, created_at, updated_at; ``batch`` has id,
    key and payload.
    """
    payload = PAPER_PAYLOAD if payload is None else payload
    old, new = stored.alias("old"), batch.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    arrived = F.col(f"new.{key}").isNotNull()
    known = F.col(f"old.{key}").isNotNull()
    changed = arrived & (~known | any_differs([F.col(f"old.{c}") for c in payload], [F.col(f"new.{c}") for c in payload]))
    return joined.select(
        F.coalesce("old.id", "new.id").alias("id"),
        F.coalesce(f"old.{key}", f"new.{key}").alias(key),
        *[F.when(arrived, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in payload],
        F.when(known, F.col("old.created_at")).otherwise(now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )

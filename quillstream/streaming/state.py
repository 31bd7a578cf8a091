"""Keyed streaming state: first sight, running counts, latest versions.

State without a watermark grows with the number of ids, as the ledger does; the
RocksDB state store of the session defaults keeps it off the JVM heap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators.perkey import last_per_key
from quillstream.streaming.tables import BatchTables


def first_seen(events: DataFrame, key: str = "source_id", order: str = "seq") -> DataFrame:
    """Running earliest arrival of each key (update mode)."""
    return events.groupBy(key).agg(F.min(order).alias("first_seq"))


def running_counts(events: DataFrame, values: str, key: str = "source_id") -> DataFrame:
    """Records per listed value, each id counted once however often it is replayed
    (update mode). Meant for ids whose repeats carry the same list; where they
    differ, the ingest job's ledger takes the first by arrival."""
    once = events.dropDuplicates([key])
    return once.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("paper_count"))


def start_upserts(changes: DataFrame, spark: SparkSession, root: str, checkpoint: str,
                  trigger: dict | None = None, keys: list[str] | None = None,
                  order: list[str] | None = None, prepare: Callable[[DataFrame, int], DataFrame] | None = None,
                  schema: T.StructType | None = None) -> tuple[StreamingQuery, BatchTables]:
    """Append each batch's new versions; ``current_state`` folds them.

    ``prepare`` turns a batch and its number into the rows that are stored, of
    ``schema``.

    With ``keys`` and ``order`` a batch is first reduced to the last version of
    each key, so what is stored follows the keys of a batch, not its events.
    """
    tables = BatchTables(spark, root, {"state": schema or T.StructType(list(changes.schema.fields))})

    def write(frame: DataFrame, batch_id: int) -> None:
        if prepare is not None:
            frame = prepare(frame, batch_id)
        if not tables.is_loaded(checkpoint, batch_id):
            tables.publish(checkpoint, batch_id, {"state": last_per_key(frame, keys, order) if keys else frame})

    if keys and not order:
        raise ValueError("keys need an order")
    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), tables


def current_state(tables: BatchTables, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Latest version of each key: by batch, or by ``order`` where batches hold several."""
    columns = tables.tables["state"].names
    return last_per_key(tables.read("state"), keys, order or ["batch_id"]).select(*columns)


def fold_state(tables: BatchTables, root: str, keys: list[str], order: list[str] | None = None) -> BatchTables:
    """A new root with one version of each key."""
    return tables.fold_into(root, {"state": current_state(tables, keys, order)})

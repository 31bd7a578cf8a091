"""Idempotent load of a message stream into the batch tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.functions.text import parse_instant
from quillstream.operators import ingest as ops
from quillstream.schemas import LIST_FIELDS, PAPER_PAYLOAD
from quillstream.sources.messages import numbered
from quillstream.streaming.ledger import StoredLedger
from quillstream.streaming.tables import BatchTables

CHECKPOINT_INTERVAL = "30 seconds"


def batch_frames(events: DataFrame, ledger: StoredLedger, now: Column, strict_instant: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows a batch adds to each table, and the frame to release afterwards.

    Facts take the last event of a key, counters the first event of a key the
    ledger lacks, dimensions take every event.
    """
    stamped = events.withColumn("crawled_at", parse_instant(F.col("crawled_at"), now, strict_instant))
    papers = stamped.groupBy("source_id").agg(
        F.max_by(F.struct(*PAPER_PAYLOAD), "seq").alias("_new"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    ).select("source_id", "_new.*", "first_seq", "last_seq", now.alias("created_at"), now.alias("loaded_at"))
    firsts = ops.first_events(events.select("source_id", "seq", "year", *LIST_FIELDS)).persist(StorageLevel.MEMORY_AND_DISK)
    new = ledger.unseen(firsts)
    frames = {
        "papers": papers,
        "dimensions": ops.all_dimension_rows(events),
        "sketches": ops.sketches(ops.listed_values(events, []), firsts),
        "ledger": new.select("source_id", F.col("seq").alias("first_seq"), now.alias("first_seen_at")),
        "counters": ops.all_deltas(new),
    }
    return frames, firsts


def load_batch(tables: BatchTables, messages: DataFrame, source: str, source_batch: int, now: datetime | None = None,
               strict_instant: bool = False, fail_fast: bool = False, limits: dict[str, int] | None = None) -> bool:
    """Load one batch of ``(seq, value)`` messages; False when it was loaded before.

    Records with a value longer than its field's entry in ``limits`` are
    quarantined; by default no length is limited.
    """
    if tables.is_loaded(source, source_batch):
        return False
    stamp = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
    parsed = ops.check_lengths(ops.parse_events(messages), limits or {})
    # the text is only wanted of what goes to quarantine
    parsed = parsed.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))).persist(StorageLevel.MEMORY_AND_DISK)
    frames, firsts = batch_frames(ops.valid_events(parsed), tables.stored_ledger(), stamp, strict_instant)
    frames["quarantine"] = ops.quarantined(parsed, fail_fast).select("seq", "value", "reason")
    try:
        tables.publish(source, source_batch, frames)
    finally:
        firsts.unpersist()
        parsed.unpersist()
    return True


def start_ingest(messages: DataFrame, tables: BatchTables, checkpoint: str, trigger: dict | None = None,
                 clock: Callable[[int], datetime] | None = None, **options) -> StreamingQuery:
    """Start the ingest query. The checkpoint records source offsets per batch, and
    a batch that was committed before a failure is skipped when it is replayed. A
    new checkpoint re-reads the source from its start; the ledger keeps the
    counters right.

    ``clock`` gives the load time of a batch; the default is the wall clock. Lines
    of a text stream are numbered batch by batch.
    """

    def write(frame: DataFrame, batch_id: int) -> None:
        if "seq" not in frame.columns:
            frame = numbered(frame, batch_id)
        # A topic with few partitions would parse on as few cores; a batch is
        # bounded by the source's rate limit, so re-spreading it is cheap.
        cores = frame.sparkSession.sparkContext.defaultParallelism
        if frame.rdd.getNumPartitions() < cores:
            frame = frame.repartition(cores, "seq")
        load_batch(tables, frame, checkpoint, batch_id, clock(batch_id) if clock else None, **options)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": CHECKPOINT_INTERVAL})).start()

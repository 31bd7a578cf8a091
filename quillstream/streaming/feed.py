"""Change notifications: from the change log, or by polling the fact table."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from quillstream import lexicon
from quillstream.operators.changes import change_events, change_rows, project_images, updated_after
from quillstream.operators.search import DEEP_PAGE
from quillstream.session import stored
from quillstream.streaming.tables import BatchTables

# One row per notification; ``via`` is the way by which it came.
EVENT = T.StructType([
    T.StructField("via", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("id", T.LongType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("event", T.StringType()),
])

LOOK_BACK = timedelta(hours=24)
POLL_INTERVAL = "3 seconds"


def log_events(log: DataFrame, schema: str, table: str, now, start: int = -1) -> DataFrame:
    """``(seq, event)`` of every changed record; works on a stream and on a table."""
    papers = project_images(change_rows(log, schema, table, start), now)
    body = papers.select("seq", F.struct(*[c for c in papers.columns if c != "seq"]).alias("payload"))
    event = F.to_json(F.struct(F.lit(lexicon.CHANGE_EVENT).alias("type"), "payload"), {"ignoreNullFields": "false"})
    return body.select("seq", event.alias("event"))


def poll(papers: DataFrame, cursor: tuple, limit: int = lexicon.POLL_LIMIT) -> tuple[DataFrame, tuple]:
    """One poll: the events of at most ``limit`` changes, and the next cursor.

    The changes of a poll come to the driver, or are stored where ``limit`` is more
    than ``DEEP_PAGE`` rows, so that cursor and events are of the same rows and
    nothing stays behind. The cursor is (updated_at, id, source_id) where there are
    source_ids, as ids may repeat; a pair, the initial cursor, is taken too.
    """
    after, after_id, *key = map(F.lit, cursor)
    at = [c for c in ("updated_at", "id", "source_id") if c in papers.columns]
    found = updated_after(papers, after, after_id, limit, *key)
    if limit > DEEP_PAGE:
        pulled = stored(found, "poll")
        last = pulled.select(*at).orderBy(*[F.desc(c) for c in at]).head()
    else:
        rows = found.collect()
        pulled, last = papers.sparkSession.createDataFrame(rows, papers.schema), rows[-1] if rows else None
    return change_events(pulled), cursor if last is None else tuple(last[c] for c in at)


def initial_cursor(now: datetime) -> tuple[datetime, int]:
    return now - LOOK_BACK, -1


def event_rows(papers: DataFrame) -> DataFrame:
    """Changed records with their notification; works on a stream and on a table."""
    body = F.struct(F.lit(lexicon.CHANGE_EVENT).alias("type"), F.struct(*[c for c in papers.columns if c != "seq"]).alias("payload"))
    return papers.select(F.col("updated_at").cast("timestamp").alias("updated_at"), F.col("id").cast("bigint").alias("id"), "source_id",
                         F.to_json(body, {"ignoreNullFields": "false"}).alias("event"))


class ChangeWatcher:
    """Notifications of changed records, kept in a table: from the change log, or by polling where that fails.

    Each way has a checkpoint of its own, which holds its cursor, and every batch
    becomes visible once, so a restarted watcher neither loses nor repeats one. What
    one way has sent the other leaves out.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.tables = BatchTables(spark, f"{self.root}/events", {"events": EVENT})

    def events(self) -> DataFrame:
        return self.tables.read("events").drop("batch_id")

    def start(self, via: str, changes: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """Start one way on a stream of changed records: their columns, ``updated_at``, ``id`` and ``source_id`` among them."""
        checkpoint = f"{self.root}/{via}"

        def write(frame: DataFrame, batch_id: int) -> None:
            if self.tables.is_loaded(checkpoint, batch_id):
                return
            # an event that came the other way has the same text; only as old ones as the batch's are looked at
            oldest = frame.agg(F.min("updated_at")).scalar()
            other = self.events().where((F.col("via") != via) & (F.col("updated_at") >= oldest)).select("source_id", "event").distinct()
            self.tables.publish(checkpoint, batch_id, {"events": frame.join(other, ["source_id", "event"], "left_anti").withColumn("via", F.lit(via))})

        writer = event_rows(changes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": POLL_INTERVAL})).start()

    def run(self, log: Callable[[], DataFrame] | None, polled: Callable[[], DataFrame], trigger: dict | None = None) -> str:
        """Follow the log until it ends; poll if it fails. Returns the way taken last."""
        if log is not None:
            try:
                self.start("log", log(), trigger).awaitTermination()
                return "log"
            except PySparkException as error:
                warnings.warn(f"change log unavailable, polling instead: {str(error)[:200]}", stacklevel=2)
        self.start("poll", polled(), trigger).awaitTermination()
        return "poll"

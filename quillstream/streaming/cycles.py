"""Watch cycles: years that fail alone, counts per year, and an outbox of records to emit."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from quillstream.operators.perkey import first_per_key, last_per_key
from quillstream.session import stored
from quillstream.streaming.tables import BatchTables

NEW, EMITTED, FAILED = "new", "emitted", "failed"

#: Years a batch may hold for its counts per year to be exact.
YEARS = 512
WORKERS = 6

OUTCOME = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("papers", T.LongType()),
    T.StructField("error", T.StringType()),
])

OUTBOX = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("reason", T.StringType()),
])


def crawl_years(spark: SparkSession, years: list[int], load: Callable[[int], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """The records of all years that could be loaded, and (year, papers, error) of every year.

    Years are loaded side by side, each into a table of its own, so what makes one
    fail, when its frame is made or while it runs, is a row of the outcome and takes
    no other year along. Without any loaded year there is no frame.
    """

    def one(year: int) -> tuple[int, DataFrame | None, int, str | None]:
        try:
            frame = stored(load(year), f"year-{year}")
            return year, frame, frame.count(), None
        except Exception as error:  # noqa: BLE001 - whatever a year fails by, the others go on
            return year, None, 0, f"{type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(WORKERS) as pool:
        done = list(pool.map(one, years))
    frames = [frame for _, frame, _, _ in done if frame is not None]
    outcome = spark.createDataFrame([(year, n, error) for year, _, n, error in done], OUTCOME)
    return (reduce(DataFrame.unionByName, frames) if frames else None), outcome


def year_counts():
    """Records of each year as one mergeable aggregate, (item, count) in any order; exact up to YEARS years."""
    return F.expr(f"approx_top_k(year, {YEARS}, {2 * YEARS})")


def observe_years(batch: DataFrame, name: str = "years") -> tuple[DataFrame, Observation]:
    """Count the records of each year as the batch flows by, without a job of its own."""
    watch = Observation(name)
    return batch.observe(watch, F.count("*").alias("processed"), year_counts().alias("years")), watch


def per_year(metrics) -> dict[int, int]:
    """Counts by year of an observed ``year_counts``."""
    return {item["item"]: item["count"] for item in metrics["years"]}


class YearCounts(StreamingQueryListener):
    """Gathers the ``observe`` metrics of a stream batch by batch; register it with ``spark.streams.addListener``."""

    def __init__(self, name: str = "years"):
        self.name, self.batches = name, defaultdict(dict)

    def observed(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.name, F.count("*").alias("processed"), year_counts().alias("years"))

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is not None and metrics["years"] is not None:
            # a batch that is run again replaces what it gave before
            self.batches[str(event.progress.id)][event.progress.batchId] = per_year(metrics)

    def totals(self) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for batches in self.batches.values():
            for counts in batches.values():
                for year, n in counts.items():
                    out[year] += n
        return dict(out)

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Outbox:
    """Records on their way out, each with its state: failed ones are tried again in the next cycle.

    A record is emitted before its state is written, so a crash in between repeats
    it; otherwise none is sent twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = BatchTables(spark, f"{self.root}/outbox", {"outbox": OUTBOX})

    def states(self) -> DataFrame:
        """(source_id, value, state, reason, cycle) of every record, as its last cycle left it."""
        return last_per_key(self.tables.read("outbox"), ["source_id"], ["batch_id"]).withColumnRenamed("batch_id", "cycle")

    def cycle(self, found: DataFrame, emit: Callable[[DataFrame], DataFrame | None], order: list[str], source: str | None = None, number: int = 0) -> dict[str, int]:
        """Emit what ``found`` (source_id, value, order columns) has that was never seen, and what failed before.

        ``emit`` gets (source_id, value) and returns (source_id, ok), or nothing when
        all went out; a record it doesn't name failed, and so did all if it raises.
        A record already known keeps the value it was first found with. Returns the
        cycle's counts.
        """
        known = stored(self.states(), "outbox-known")
        fresh = first_per_key(found.select("source_id", "value", *[c for c in order if c not in ("source_id", "value")]), ["source_id"], order)
        fresh = fresh.select("source_id", "value").join(known.select("source_id"), "source_id", "left_anti").withColumn("state", F.lit(NEW))
        again = known.where(F.col("state") == FAILED).select("source_id", "value", "state")
        due = stored(fresh.unionByName(again), "outbox-due")
        sent, reason = None, None
        try:
            sent = emit(due.select("source_id", "value"))
            sent = None if sent is None else stored(sent.groupBy("source_id").agg(F.bool_and("ok").alias("ok")), "outbox-sent")
        except Exception as error:  # noqa: BLE001 - the next cycle tries again
            reason = f"{type(error).__name__}: {error}"[:500]
        if reason is not None:
            rows = due.select("source_id", "value", F.lit(FAILED).alias("state"), F.lit(reason).alias("reason"))
        else:
            joined = due.withColumn("ok", F.lit(True)) if sent is None else due.join(sent, "source_id", "left")
            ok = F.coalesce("ok", F.lit(False))
            rows = joined.select("source_id", "value", F.when(ok, EMITTED).otherwise(FAILED).alias("state"), F.when(~ok, "not emitted").alias("reason"))
        batch = self.tables.publish(source or f"{self.root}/cycles", number if source else self.tables.last_committed() + 1, {"outbox": rows})
        mine = self.tables.read("outbox").where(F.col("batch_id") == batch)
        counts = dict(mine.groupBy("state").agg(F.count("*")).collect())
        return {"new": due.where(F.col("state") == NEW).count(), "retried": due.where(F.col("state") == FAILED).count(),
                "emitted": counts.get(EMITTED, 0), "failed": counts.get(FAILED, 0), "seen": known.count()}

    def watch(self, found: DataFrame, emit: Callable[[DataFrame], DataFrame | None], order: list[str]) -> list[dict[str, int]]:
        """One watch cycle over what a stream has that is new: a batch is a cycle, and without one what failed is tried again."""
        checkpoint, cycles = f"{self.root}/checkpoint", []

        def write(frame: DataFrame, batch_id: int) -> None:
            if not self.tables.is_loaded(checkpoint, batch_id):
                cycles.append(self.cycle(frame, emit, order, checkpoint, batch_id))

        found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not cycles:
            none = self.spark.createDataFrame([], found.schema)
            cycles.append(self.cycle(none, emit, order))
        return cycles

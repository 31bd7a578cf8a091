"""Tables that become visible per micro-batch, all together or not at all.

A batch appends its own rows to every table under ``batch_id=<n>`` and writes a
commit row last; readers keep only committed batches. Nothing stored is read or
rewritten to add a batch, so its cost follows the batch, not the table. Readers
fold the appended rows (newest record, distinct values, summed counters), and
``fold_into`` starts a fresh root from the folded state to keep the number of
batches bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quillstream import schemas
from quillstream.operators.perkey import any_differs
from quillstream.schemas import PAPER_PAYLOAD
from quillstream.streaming.ledger import StoredLedger, based, filters

TABLES = {
    "papers": schemas.PAPER_DELTA,
    "papers_base": schemas.PAPER_DELTA,
    "dimensions": schemas.DIMENSION,
    "ledger": schemas.LEDGER,
    "ledger_base": schemas.LEDGER_BASE,
    "ledger_filters": schemas.LEDGER_FILTER,
    "counters": schemas.COUNTER_DELTA,
    "sketches": schemas.SKETCH,
    "quarantine": schemas.QUARANTINE,
}

# Tables whose readers want one kind of row: each kind is a folder of its own.
_SPLIT_BY = {"dimensions": "dimension", "counters": "counter", "ledger_base": "bucket", "papers_base": "year"}

_COMMITS = "commits"
_COMMIT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_batch", T.LongType()),
])
_BATCH = T.StructField("batch_id", T.LongType())


def _together(do: Callable, items: Iterable) -> None:
    """Jobs that do not depend on each other share the cluster; the first failure is raised."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        list(pool.map(do, items))


class BatchTables:
    """The tables under one shared root folder; one streaming query writes to it."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, T.StructType] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = TABLES if tables is None else tables
        _together(self._create, {**self.tables, _COMMITS: _COMMIT_SCHEMA}.items())

    def _create(self, table: tuple[str, T.StructType]) -> None:
        """An empty part gives a table a readable schema before the first batch."""
        name, schema = table
        split = _SPLIT_BY.get(name)
        empty = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != split])
        none = "-1" if split and schema[split].dataType == T.IntegerType() else "none"
        folder = f"{self._path(name)}/batch_id=-1" + (f"/{split}={none}" if split else "")
        empty.coalesce(1).write.mode("ignore").parquet(folder)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _rows(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(self._path(name))

    def _commits(self) -> DataFrame:
        return self._rows(_COMMITS, _COMMIT_SCHEMA)

    def last_committed(self) -> int:
        """Highest committed batch, -1 before the first; reads one row per batch."""
        found = self._commits().agg(F.max("batch_id")).head()[0]
        return -1 if found is None else found

    def is_loaded(self, source: str, source_batch: int) -> bool:
        """Whether this batch of this source (a query's checkpoint) was committed."""
        mine = self._commits().where(F.col("source") == source).agg(F.max("source_batch")).head()[0]
        return mine is not None and source_batch <= mine

    def publish(self, source: str, source_batch: int, frames: dict[str, DataFrame]) -> int:
        """Write every table of a batch, then its commit row.

        A batch that failed half-way is unreadable, and the next attempt, which
        takes the same batch id, overwrites it.
        """
        batch_id = self.last_committed() + 1
        self._write(batch_id, frames)
        commit = self.spark.range(1).select(F.lit(source).alias("source"), F.lit(source_batch).cast("bigint").alias("source_batch"))
        self._commit(batch_id, commit)
        return batch_id

    def _write(self, batch_id: int, frames: dict[str, DataFrame]) -> None:
        def write(table: tuple[str, DataFrame]) -> None:
            name, frame = table
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[name].fields]
            writer = frame.select(*columns).write.mode("overwrite")
            if name in _SPLIT_BY:
                writer = writer.partitionBy(_SPLIT_BY[name])
            writer.parquet(f"{self._path(name)}/batch_id={batch_id}")

        _together(write, frames.items())

    def _commit(self, batch_id: int, commits: DataFrame) -> None:
        # One file, so it appears in one rename.
        commits.coalesce(1).write.mode("overwrite").parquet(f"{self._path(_COMMITS)}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        """Rows of committed batches only.

        Batch ids grow by one per committed batch, so the bound is one scalar
        that prunes the batch folders.
        """
        rows = self._rows(name, self.tables[name])
        return rows.where(F.col("batch_id") <= self.last_committed())

    # Folded views -----------------------------------------------------------

    def papers(self) -> DataFrame:
        """Newest version of each record."""
        return self._folded_papers().drop("last_seq")

    def _folded_papers(self) -> DataFrame:
        """The base's records that no batch since has touched, as they are, and the others folded.

        The base lies in a folder for each year, so a filter on the year prunes it;
        only ids of recent batches are compared with it.
        """
        recent, base = self.read("papers"), self.read("papers_base")
        if base.isEmpty():
            return self._fold(recent)
        touched = recent.select("source_id").distinct()
        as_stored = base.join(touched, "source_id", "left_anti").withColumnsRenamed({"first_seq": "id", "loaded_at": "updated_at"})
        before = base.join(touched, "source_id", "left_semi")
        folded = self._fold(recent.drop("batch_id").unionByName(before.drop("batch_id")))
        return as_stored.select(*folded.columns).unionByName(folded)

    @staticmethod
    def _fold(versions: DataFrame) -> DataFrame:
        """``id`` orders records by first arrival, ``created_at`` is the load time
        of the first version and ``updated_at`` that of the last version that
        changed a value. The window holds at most one row per batch and record.
        """
        history = Window.partitionBy("source_id").orderBy("last_seq")
        previous = [F.lag(c).over(history) for c in PAPER_PAYLOAD]
        first = F.row_number().over(history) == 1
        changed = first | any_differs([F.col(c) for c in PAPER_PAYLOAD], previous)
        versions = versions.withColumn("_changed", changed)
        newest = F.struct(*PAPER_PAYLOAD)
        folded = versions.groupBy("source_id").agg(
            F.min("first_seq").alias("id"),
            F.max("last_seq").alias("last_seq"),
            F.max_by(newest, "last_seq").alias("_new"),
            F.min("created_at").alias("created_at"),
            F.max(F.when(F.col("_changed"), F.col("loaded_at"))).alias("updated_at"),
        )
        return folded.select("id", "source_id", *[F.col("_new")[c].alias(c) for c in PAPER_PAYLOAD], "created_at", "updated_at", "last_seq")

    def dimension(self, name: str) -> DataFrame:
        return self.read("dimensions").where(F.col("dimension") == name).select("source_id", "value").distinct()

    def stored_ledger(self) -> StoredLedger:
        return StoredLedger(self.read("ledger"), self.read("ledger_base"), self.read("ledger_filters"))

    def ledger(self) -> DataFrame:
        parts = self.read("ledger").unionByName(self.read("ledger_base").drop("bucket"))
        return parts.groupBy("source_id").agg(
            F.min("first_seq").alias("first_seq"), F.min("first_seen_at").alias("first_seen_at"))

    def all_counters(self) -> DataFrame:
        return self.read("counters").groupBy("counter", "value").agg(F.sum("paper_count").alias("paper_count"))

    def counter(self, name: str) -> DataFrame:
        """One counter as ``(value, paper_count)``."""
        deltas = self.read("counters").where(F.col("counter") == name)
        return deltas.groupBy("value").agg(F.sum("paper_count").alias("paper_count"))

    def united_sketches(self) -> DataFrame:
        return self.read("sketches").groupBy("name").agg(F.hll_union_agg("sketch").alias("sketch"))

    def summary(self) -> DataFrame:
        """Totals in one row without reading a record: papers from the counters, distinct
        numbers from sketches, a few rows a batch. Years are those of first events."""
        counted = self.read("counters").where(F.col("counter") == "yearly").agg(F.coalesce(F.sum("paper_count"), F.lit(0)).alias("n"))
        united = self.united_sketches()
        numbers = [F.coalesce(F.max(F.when(F.col("name") == n, F.hll_sketch_estimate("sketch"))), F.lit(0)).alias(n) for n in ("years", "keywords", "authors", "institutions")]
        return united.agg(*numbers).select(counted.scalar().alias("papers"), "years", "keywords", "authors", "institutions")

    def quarantine(self) -> DataFrame:
        return self.read("quarantine").select("seq", "value", "reason")

    def fold_into(self, root: str, folded: dict[str, DataFrame] | None = None) -> BatchTables:
        """A new root that starts from the folded state.

        Run it when no batch is being written, then point the query at the new
        root: replays of older batches are still recognised. ``folded`` gives the
        content of tables other than those of the ingest job.
        """
        folds = {
            "papers": lambda: self.read("papers").limit(0),
            "papers_base": lambda: self._folded_papers().withColumnsRenamed({"id": "first_seq", "updated_at": "loaded_at"}).repartition("year"),
            "dimensions": lambda: self.read("dimensions").select("dimension", "source_id", "value").distinct(),
            # all of it becomes the base
            "ledger": lambda: self.read("ledger").limit(0),
            "ledger_base": lambda: based(self.ledger()),
            "ledger_filters": lambda: filters(self.ledger()),
            "counters": self.all_counters,
            "sketches": self.united_sketches,
            "quarantine": self.quarantine,
        }
        given = folded or {}
        unknown = [name for name in self.tables if name not in given and name not in folds]
        if unknown:
            raise ValueError(f"no folded content for {', '.join(unknown)}")
        target = BatchTables(self.spark, root, self.tables)
        target._write(0, {name: given[name] if name in given else folds[name]() for name in self.tables})
        target._commit(0, self._commits().groupBy("source").agg(F.max("source_batch").alias("source_batch")))
        return target

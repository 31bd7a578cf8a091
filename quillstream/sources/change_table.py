"""A stream over the changes of a stored table, by its own order of change.

The offset is the place ``(updated_at, id, source_id)`` of the last change sent, so
a query's checkpoint holds the cursor: a restarted query goes on behind it, rows
that share time and id included. Files of the table only ever get more.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CURSOR = ("updated_at", "id", "source_id")
_LEAST_ID = -(1 << 63)


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _times(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Microseconds since 1970 of timestamps of any unit."""
    return pc.cast(pc.cast(column, pa.timestamp("us", tz=getattr(column.type, "tz", None)), safe=False), pa.int64())


def _places(table: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The three parts of each row's place; a null id is the least, a null source_id empty, a null time is never sent."""
    return _times(table["updated_at"]), pc.fill_null(pc.cast(table["id"], pa.int64()), _LEAST_ID), pc.fill_null(pc.cast(table["source_id"], pa.string()), "")


def _beyond(places: tuple, cursor: dict) -> pa.Array:
    """Rows behind a cursor."""
    out = pc.greater(places[2], cursor["source_id"])
    for part, name in ((places[1], "id"), (places[0], "updated_at")):
        out = pc.or_(pc.greater(part, cursor[name]), pc.and_(pc.equal(part, cursor[name]), out))
    return pc.fill_null(out, False)


class Part(InputPartition):
    def __init__(self, path: str, group: int, start: dict, end: dict):
        self.path, self.group, self.start, self.end = path, group, start, end


class ChangeReader(DataSourceStreamReader):
    """Reads row groups that may hold changes between two offsets; options see :class:`ChangeTable`."""

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema, options["path"]
        self.after = int(options.get("after", _micros(datetime.now(timezone.utc) - timedelta(hours=24))))
        self.settle = float(options.get("settle", 1))
        #: File -> its row groups' spans of time, and the newest place once the whole file has settled.
        self.spans: dict[str, list[tuple[int, int] | None]] = {}
        self.newest: dict[str, tuple] = {}
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"updated_at": self.after, "id": (1 << 63) - 1, "source_id": ""}

    def _store(self) -> tuple[fs.FileSystem, str]:
        """The file system that holds the table, and its folder there."""
        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _files(self) -> list[str]:
        system, root = self._store()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def _open(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(path, filesystem=self._store()[0])

    def _groups(self, path: str) -> list[tuple[int, int] | None]:
        """First and last time of each row group, from its statistics or else its column; None where it has no time."""
        if path not in self.spans:
            file, spans = self._open(path), []
            at = file.schema_arrow.get_field_index("updated_at")
            leaf = next(i for i in range(file.metadata.num_columns) if file.schema.column(i).path == file.schema_arrow.field(at).name)
            for g in range(file.num_row_groups):
                stats = file.metadata.row_group(g).column(leaf).statistics
                if stats is not None and stats.physical_type == "INT64" and stats.has_min_max and isinstance(stats.min, datetime):
                    spans.append((_micros(stats.min), _micros(stats.max)))
                else:
                    times = pc.min_max(_times(file.read_row_group(g, columns=["updated_at"])["updated_at"])).as_py()
                    spans.append(None if times["min"] is None else (times["min"], times["max"]))
            self.spans[path] = spans
        return self.spans[path]

    def _newest(self, path: str, horizon: int) -> tuple | None:
        """The greatest place up to the horizon in a file."""
        if path in self.newest:
            return self.newest[path]
        spans = [(g, s) for g, s in enumerate(self._groups(path)) if s and s[0] <= horizon]
        best = None
        for g, span in sorted(spans, key=lambda x: -x[1][1]):
            if best and span[1] < best[0]:
                break
            at, ids, keys = _places(self._open(path).read_row_group(g, columns=list(CURSOR)))
            # the newest time first, then the greatest id and key among its rows
            place, rows = [], pc.fill_null(pc.less_equal(at, horizon), False)
            for part in (at, ids, keys):
                top = pc.max(pc.filter(part, rows)).as_py()
                if top is None:
                    break
                place.append(top)
                rows = pc.and_(rows, pc.fill_null(pc.equal(part, top), False))
            if len(place) == 3 and (best is None or tuple(place) > best):
                best = tuple(place)
        if all(s is None or s[1] <= horizon for s in self._groups(path)) and best:
            self.newest[path] = best
        return best

    def latestOffset(self) -> dict:
        """The newest place that has settled: its time was over ``settle`` seconds ago."""
        horizon = _micros(datetime.now(timezone.utc)) - int(self.settle * 1_000_000)
        places = [p for p in (self._newest(f, horizon) for f in self._files()) if p]
        newest = self.last or self.initialOffset()
        for place in places:
            if place > tuple(newest[c] for c in CURSOR):
                newest = dict(zip(CURSOR, place))
        self.last = newest
        return newest

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path, g, start, end) for path in self._files() for g, span in enumerate(self._groups(path))
                if span and span[1] >= start["updated_at"] and span[0] <= end["updated_at"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        table = self._open(partition.path).read_row_group(partition.group, columns=self.columns.names)
        places = _places(table)
        table = table.filter(pc.and_(_beyond(places, partition.start), pc.invert(_beyond(places, partition.end))))
        yield from table.select(self.columns.names).cast(to_arrow_schema(self.columns), safe=False).to_batches()


class ChangeTable(DataSource):
    """``format("change_table")``: options ``path``, a folder of Parquet files that all executors reach; ``after``,
    microseconds since 1970 from which a new query starts, by default a day ago; ``settle``, seconds for which a
    change waits, so that others of the same time are all there, by default one.
    """

    @classmethod
    def name(cls) -> str:
        return "change_table"

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(schema, self.options)


def change_stream(spark: SparkSession, path: str, schema: StructType, after: datetime | None = None, settle: float = 1) -> DataFrame:
    """The changes of a table, each sent once; ``after`` is where a query without a checkpoint starts."""
    missing = [c for c in CURSOR if c not in schema.names]
    if missing:
        raise ValueError(f"a change table needs the columns {', '.join(missing)}")
    spark.dataSource.register(ChangeTable)
    reader = spark.readStream.format("change_table").schema(schema).option("path", path).option("settle", str(settle))
    if after is not None:
        reader = reader.option("after", str(_micros(after)))
    return reader.load()

"""Helpers shared by the operators: written tables, Arrow maps, words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillstream.session import shared_dir

#: Words are runs of anything but these six ASCII blanks, the ones ``bytes.split`` knows.
BLANKS = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: Folders that ``written`` has made and nobody has deleted, in order.
_made: list[str] = []


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The folders written while it was open; ``delete`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.start = len(_made)
        return self

    def __exit__(self, *_) -> None:
        self.paths += _made[self.start:]
        del _made[self.start:]

    def delete(self, reader: DataFrame | None = None) -> None:
        """Delete the folders, but those from which ``reader`` still reads."""
        used = reader.inputFiles() if reader is not None and self.paths else []
        # a listed file names its store, the folder may not
        kept = {p for p in self.paths for f in used if f"{p.split(':', 1)[-1].lstrip('/')}/" in f}
        context = self.spark.sparkContext
        for path in self.paths:
            if path not in kept:
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = [p for p in self.paths if p in kept]


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 256) -> DataFrame:
    """Arrow batches through a function of column lists.

    ``make`` runs once per task and returns the function; it gets lists by column
    name for at most ``rows`` rows at a time and returns lists or Arrow arrays.
    """
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip((out[f.name] for f in kinds), kinds)],
                    schema=kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(StructType.fromDDL(schema))

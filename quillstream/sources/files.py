"""File sources: JSON records, stored pages, tables and the seen-id list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstream.schemas import PAGE, PAPER_EVENT


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json_records(spark: SparkSession, path: str, schema=PAPER_EVENT, layout: str = "auto") -> DataFrame:
    """JSON array or JSON lines.

    ``auto`` looks at the first non-blank line: ``[`` opens an array. JSON lines
    split across tasks; an array file is one task per file, so prefer lines for
    large data. Blank lines are skipped.
    """
    if layout == "auto":
        head = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").alias("v")).head()
        layout = "array" if head is not None and head["v"].startswith("[") else "lines"
    return spark.read.schema(schema).json(path, multiLine=layout == "array")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def read_seen(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame:
    """Emitted ids, one per line, blanks ignored."""
    ids = spark.read.text(path).select(F.trim("value").alias(key))
    return ids.where(F.col(key) != "")


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Any JDBC table; pass partitionColumn, lowerBound, upperBound and
    numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()

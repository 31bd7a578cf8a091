"""Streaming message sources: a topic, or files of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstream.schemas import MESSAGE

# Bits of ``seq`` that hold the offset inside a partition.
OFFSET_BITS = 44


def topic_stream(spark: SparkSession, brokers: str, topic: str, group: str | None = None, starting: str = "earliest",
                 **options) -> DataFrame:
    """``(seq, value)`` of a topic; needs the Kafka connector on the classpath.

    Messages are keyed by id, so all of a key's messages share a partition and
    the partition offset orders them. ``seq`` holds the partition above the offset
    and is unique in the topic.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    reader = reader.option("startingOffsets", starting).options(**options)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.load().select(F.shiftleft(F.col("partition").cast("bigint"), OFFSET_BITS).bitwiseOR(F.col("offset")).alias("seq"), F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=MESSAGE, max_files: int | None = None) -> DataFrame:
    """Messages or rows that arrive as files; declare the schema, nothing is inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as ``(at, file, block, value)``, to be ``numbered`` per batch.

    ``at`` is the file's time and ``block`` where in the file a task began to read.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered(lines: DataFrame, batch_id: int) -> DataFrame:
    """``(seq, value)`` of a batch of ``text_stream``: unique, by file time, file and place in the file.

    ``seq`` holds the batch above the place in it. Only blocks, some a file, are put
    in order; lines are counted where they are, as a task reads a block from line to line.
    """
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    blocks = lines.groupBy("at", "file", "block").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    upto = Window.orderBy("at", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"))
    place = F.lit(batch_id << OFFSET_BITS).cast("bigint") + F.col("line") + F.col("shift")
    return lines.join(starts, ["file", "block"]).select(place.alias("seq"), "value")

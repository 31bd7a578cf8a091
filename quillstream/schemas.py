"""Declared schemas; nothing in the engine infers one."""

from pyspark.sql import types as T

_texts = T.ArrayType(T.StringType())

# Wire form of one record.
PAPER_EVENT = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", _texts),
    T.StructField("institutions", _texts),
    T.StructField("abstract", T.StringType()),
    T.StructField("keywords", _texts),
    T.StructField("paper_url", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("crawled_at", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# One row per record and micro-batch; readers fold them to the newest.
PAPER_DELTA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("paper_url", T.StringType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("crawled_at", T.TimestampType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("loaded_at", T.TimestampType()),
])

DIMENSION = T.StructType([
    T.StructField("dimension", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("value", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("first_seen_at", T.TimestampType()),
])

LEDGER_BASE = T.StructType([*LEDGER.fields, T.StructField("bucket", T.IntegerType())])

# Bloom filters of the base's ids.
LEDGER_FILTER = T.StructType([
    T.StructField("bucket", T.IntegerType()),
    T.StructField("segments", T.IntegerType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("bits", T.BinaryType()),
])

COUNTER_DELTA = T.StructType([
    T.StructField("counter", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("paper_count", T.LongType()),
])

SKETCH = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("sketch", T.BinaryType()),
])

QUARANTINE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType()),
])

# Columns the last write of a record replaces.
PAPER_PAYLOAD = ["year", "title", "abstract", "paper_url", "pdf_url", "crawled_at"]
LIST_FIELDS = ["authors", "institutions", "keywords"]

"""The ledger of seen ids: which of a batch's ids are new, without reading it whole.

A ledger has two parts. Batches append to the recent part, which folding empties.
Folding writes the base: ids dealt to buckets by hash, each bucket a folder with
its ids sorted, and a Bloom filter for every few thousand ids of a bucket. The ids
of a batch are first tested against the filters; what may be known is looked up,
in its buckets only and in the place where they lie.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from quillstream.session import BROADCAST_LIMIT_BYTES

BUCKETS = 64
#: Bits of a filter, those of Spark's bitmaps, and how many of them an id sets.
FILTER_BITS = 32_768
PROBES = 4
#: Ids a filter is made for; about one in a hundred ids it has not seen passes it then.
FILTER_IDS = 3_000


def unseen(keys: DataFrame, ledger: DataFrame, key: str = "source_id", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Rows of ``keys`` (one per key, already persisted) that the ledger lacks.

    The ledger is the big side. When the batch's keys measure at most ``limit``
    bytes they are broadcast to it: the ledger is scanned in place and only its
    matches move. Beyond the limit both sides are shuffled by key.
    """
    return keys.join(_known(keys.select(key), ledger, key, limit), key, "left_anti")


def _known(keys: DataFrame, ledger: DataFrame, key: str, limit: int) -> DataFrame:
    size = keys.agg(F.coalesce(F.sum(F.octet_length(key) + 16), F.lit(0))).head()[0]
    if size <= limit:
        return ledger.select(key).join(F.broadcast(keys), key, "left_semi").distinct()
    return ledger.select(key).distinct()


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _probes(key: Column) -> list[Column]:
    """Places of an id's bits, from two hashes."""
    one, two = F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key)
    # halves, so that the sums stay in range
    return [F.pmod(F.shiftright(one, 32) + i * F.shiftright(two, 32), F.lit(FILTER_BITS)) for i in range(PROBES)]


def _segment(key: Column, segments: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("s"), key), segments).cast("int")


def based(ledger: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The base's rows: ``ledger`` with its bucket, one task and so one sorted file for each bucket."""
    return ledger.withColumn("bucket", bucket_of(F.col("source_id"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "source_id")


def filters(ledger: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, segments, segment, bits): Bloom filters of the ids, as many a bucket as FILTER_IDS asks for."""
    segments = max(1, -(-ledger.count() // (buckets * FILTER_IDS)))
    key = F.col("source_id")
    rows = ledger.select(bucket_of(key, buckets).alias("bucket"), F.lit(segments).alias("segments"), _segment(key, F.lit(segments)).alias("segment"),
                         F.explode(F.array(*_probes(key))).alias("place"))
    return rows.groupBy("bucket", "segments", "segment").agg(F.bitmap_construct_agg("place").alias("bits"))


def maybe_known(keys: DataFrame, bloom: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``keys`` with their bucket that their filter does not rule out; ``bloom`` has one number of segments."""
    key = F.col("source_id")
    segments = bloom.agg(F.max("segments")).scalar()
    rows = keys.select(key, bucket_of(key, buckets).alias("_bucket"), _segment(key, segments).alias("_segment"))
    joined = rows.join(bloom.select("bucket", "segment", "bits"), (F.col("_bucket") == F.col("bucket")) & (F.col("_segment") == F.col("segment")))

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    passed = F.lit(True)
    for place in _probes(key):
        passed = passed & is_set(place)
    return joined.where(passed).select("source_id", "bucket")


class StoredLedger:
    """A ledger in its stored parts."""

    def __init__(self, recent: DataFrame, base: DataFrame, bloom: DataFrame):
        self.recent, self.base, self.bloom = recent, base, bloom

    def unseen(self, keys: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
        """Rows of ``keys`` (one per source_id, persisted) that neither part has."""
        new = unseen(keys, self.recent, limit=limit)
        known = self.known(keys, limit)
        return new if known is None else new.join(known, "source_id", "left_anti")

    def known(self, keys: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame | None:
        """The ids of ``keys`` that the base has; None when its filters rule all of them out."""
        maybe = maybe_known(keys.select("source_id"), self.bloom).persist(StorageLevel.MEMORY_AND_DISK)
        # at most one row for each bucket comes to the driver
        touched = maybe.groupBy("bucket").agg(F.min("source_id").alias("low"), F.max("source_id").alias("high")).collect()
        if not touched:
            maybe.unpersist()
            return None
        low, high = min(r["low"] for r in touched), max(r["high"] for r in touched)
        part = self.base.where(F.col("bucket").isin([r["bucket"] for r in touched]) & F.col("source_id").between(low, high))
        return _known(maybe.select("source_id"), part, "source_id", limit)

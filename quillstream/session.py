"""Session defaults, the shared work folder and two plan-size helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that make sense at any scale. Shuffle partition counts, memory and
# master stay with whoever submits the job; AQE coalesces and splits at runtime.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# A side is broadcast only when measured at or below this many bytes.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

# Inputs smaller than this per core are re-spread before CPU-heavy text work.
SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024


def build_session(app: str = "quillstream", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Set what results depend on in a session built elsewhere, the time zone; the rest stays the caller's."""
    zone = "spark.sql.session.timeZone"
    if spark.conf.get(zone) != DEFAULTS[zone]:
        spark.conf.set(zone, DEFAULTS[zone])
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to the machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/quillstream/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, taken without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Re-spread an input too small to fill the cores; leave large inputs alone.

    A lone small file is one row group and so one task. Above
    ``SPREAD_BYTES_PER_CORE`` per core the scan has enough splits of its own and
    shuffling whole texts would be the bottleneck, so the plan is unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores, *keys)
    return df

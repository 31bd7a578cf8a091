"""Message sinks: a topic, JSON lines, and the list of emitted ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstream.operators.records import to_messages


def publish_topic(papers: DataFrame, brokers: str, topic: str, **options) -> None:
    """Keyed messages to a topic; needs the Kafka connector on the classpath."""
    writer = to_messages(papers).write.format("kafka").option("kafka.bootstrap.servers", brokers)
    writer.option("topic", topic).options(**options).save()


def publish_dry_run(papers: DataFrame, path: str, pretty: bool = False) -> None:
    """The same messages as text, one JSON per line unless ``pretty``."""
    to_messages(papers, pretty=pretty).select("value").write.mode("append").text(path)


def append_seen(emitted: DataFrame, path: str, key: str = "source_id") -> None:
    """Record ids after they were emitted: a crash in between repeats, never loses."""
    emitted.select(F.col(key).alias("value")).write.mode("append").text(path)

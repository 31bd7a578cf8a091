"""Watch cycles: years that fail alone, counts per year, records that are sent again."""

import time

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ingest as ops
from quillstream.sources.messages import file_stream
from quillstream.streaming import cycles
from quillstream.streaming.cycles import Outbox


def test_a_broken_year_leaves_the_rest(spark):
    papers = spark.createDataFrame([(2020 + i % 3, f"p{i}") for i in range(9)], "year int, source_id string")

    def load(year):
        if year == 2021:
            raise OSError("page gone")
        rows = papers.where(F.col("year") == year)
        return rows.withColumn("source_id", F.raise_error(F.lit("bad row")).cast("string")) if year == 2022 else rows

    found, outcome = cycles.crawl_years(spark, [2020, 2021, 2022, 2023], load)
    assert {r["source_id"] for r in found.collect()} == {"p0", "p3", "p6"}
    rows = {r["year"]: r for r in outcome.collect()}
    assert [rows[y]["papers"] for y in sorted(rows)] == [3, 0, 0, 0]
    assert rows[2020]["error"] is None and rows[2023]["error"] is None
    assert "page gone" in rows[2021]["error"] and "bad row" in rows[2022]["error"]
    assert cycles.crawl_years(spark, [2021], load)[0] is None


def test_counts_per_year_come_with_the_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(2000 + (i * k) % 4, i) for i in range(20)], "year int, n int").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    listener = cycles.YearCounts()
    spark.streams.addListener(listener)
    try:
        stream = file_stream(spark, str(tmp_path / "in" / "*"), schema="year int, n int", max_files=1)
        listener.observed(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if sum(listener.totals().values()) == 60:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals() == {2000: 20 + 5 + 10, 2001: 5, 2002: 5 + 10, 2003: 5}
    assert len(next(iter(listener.batches.values()))) == 3
    watched, counts = cycles.observe_years(spark.createDataFrame([(None,), (1,), (1,)], "year int"))
    watched.count()
    assert cycles.per_year(counts.get)[1] == 2


def test_failed_emits_are_sent_next_cycle_and_nothing_twice(spark, tmp_path):
    outbox, sent = Outbox(spark, str(tmp_path)), []

    def found(*ids):
        return spark.createDataFrame([(i, f"v{i}-{k}", k) for k, i in enumerate(ids)], "source_id string, value string, n int")

    def emit(broken):
        def run(due):
            rows = [r["source_id"] for r in due.collect()]
            sent.extend(r for r in rows if r not in broken)
            return due.select("source_id", (~F.col("source_id").isin(list(broken))).alias("ok"))
        return run

    assert outbox.cycle(found("a", "b", "a", "c"), emit({"b"}), ["n"]) == {"new": 3, "retried": 0, "emitted": 2, "failed": 1, "seen": 0}
    assert outbox.cycle(found("a", "d"), emit({"b"}), ["n"]) == {"new": 1, "retried": 1, "emitted": 1, "failed": 1, "seen": 3}

    def refuse(due):
        raise RuntimeError("no broker")

    assert outbox.cycle(found("e"), refuse, ["n"]) == {"new": 1, "retried": 1, "emitted": 0, "failed": 2, "seen": 4}
    # a new outbox over the same folder goes on where the last one was
    outbox = Outbox(spark, str(tmp_path))
    assert {r["source_id"] for r in outbox.states().where("state = 'failed'").collect()} == {"b", "e"}
    assert outbox.cycle(found("a", "b", "e"), emit(set()), ["n"]) == {"new": 0, "retried": 2, "emitted": 2, "failed": 0, "seen": 5}
    assert sorted(sent) == ["a", "b", "c", "d", "e"]
    assert {r["source_id"]: r["value"] for r in outbox.states().collect()}["b"] == "vb-1"
    # a record that emit does not name was not sent
    outbox.cycle(found("f"), lambda due: due.where("false").select("source_id", F.lit(True).alias("ok")), ["n"])
    assert [r["source_id"] for r in outbox.states().where("state = 'failed'").collect()] == ["f"]


def test_cycles_over_a_stream(spark, tmp_path):
    rows = "source_id string, value string, n int"
    outbox, stream = Outbox(spark, str(tmp_path / "o")), lambda: file_stream(spark, str(tmp_path / "in" / "*"), schema=rows, max_files=1)

    def add(name, *ids):
        spark.createDataFrame([(i, "v", k) for k, i in enumerate(ids)], rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    only = lambda *ids: lambda due: due.select("source_id", F.col("source_id").isin(list(ids)).alias("ok"))
    add("1", "a", "b")
    assert [c["emitted"] for c in outbox.watch(stream(), only("a"), ["n"])] == [1]
    add("2", "c", "a")
    assert [(c["new"], c["retried"], c["failed"]) for c in outbox.watch(stream(), only("c"), ["n"])] == [(1, 1, 1)]
    # nothing new came, what failed is tried again
    assert [(c["new"], c["emitted"]) for c in outbox.watch(stream(), only("b"), ["n"])] == [(0, 1)]
    assert outbox.states().where("state <> 'emitted'").count() == 0


def test_two_increments_one_dimension_row(spark):
    events = spark.createDataFrame(
        [(1, "P1", ["Deep", "deep", "José "]), (2, "p1 ", ["DEEP"]), (3, "p2", ["jose", " ", None]), (0, "p3", ["x"])],
        "seq bigint, source_id string, authors array<string>")
    rows = ops.keyed_dimension(events, "authors").orderBy("source_id_key", "value_key").collect()
    assert [tuple(r) for r in rows] == [("p1", "deep", "P1", "Deep", 1), ("p1", "jose", "P1", "José ", 1), ("p2", "jose", "p2", "jose", 3), ("p3", "x", "p3", "x", 0)]
    firsts = ops.first_events_keyed(events)
    assert sorted(r["source_id"] for r in firsts.collect()) == ["P1", "p2", "p3"]
    deltas = ops.keyed_deltas(firsts, "authors")
    assert {r["value"]: r["paper_count"] for r in deltas.collect()} == {"Deep": 2, "José ": 2, "x": 1}
    later = spark.createDataFrame([("deep", "dEEp", 9, 4), ("new", "New", 8, 1)], deltas.schema.simpleString()[7:-1].replace(":", " "))
    merged = ops.merge_keyed(deltas, later, ["value_key"])
    assert {r["value"]: (r["first_seq"], r["paper_count"]) for r in merged.collect()} == {"Deep": (1, 6), "José ": (1, 2), "x": (0, 1), "New": (8, 1)}


@pytest.mark.parametrize("n", [50, 60_000])
def test_sketches_of_batches_unite(spark, n):
    def batch(low, high):
        ids = spark.range(low, high)
        dims = ids.select(F.lit("authors").alias("dimension"), F.concat(F.lit("p"), "id").alias("source_id"), F.concat(F.lit("a"), F.col("id") % (n // 2)).alias("value"))
        dims = dims.unionByName(dims.select(F.lit("keywords").alias("dimension"), "source_id", F.lit("the").alias("value")))
        return ops.sketches(dims, ids.select(F.concat(F.lit("p"), "id").alias("source_id"), (F.col("id") % 7).alias("year")))

    both = batch(0, 2 * n // 3).unionByName(batch(n // 3, n))
    got = {r["name"]: r["n"] for r in both.groupBy("name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).collect()}
    for name, exact in {"papers": n, "authors": n // 2, "years": 7}.items():
        assert abs(got[name] - exact) <= 0.02 * exact, (name, got)
    assert "keywords" not in got

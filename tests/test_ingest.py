"""Parsing rules, per-key rules and counters of the load."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ingest as ops
from quillstream.operators.perkey import insert_absent

EVENT = "seq bigint, source_id string, year int, authors array<string>, institutions array<string>, keywords array<string>"


def parse(spark, *values):
    messages = spark.createDataFrame(list(enumerate(values)), "seq bigint, value string")
    return [r for r in ops.parse_events(messages).orderBy("seq").collect()]


def test_parse_coercions(spark):
    rows = parse(
        spark,
        json.dumps({"source_id": " s ", "year": "2024", "title": " A \t b ", "authors": [" x", "x ", None, 3, {"a": 1}, ["n"], True, ""]}),
        json.dumps({"source_id": 7, "year": 2024.9, "title": True, "abstract": {"a": 1}, "paper_url": [1], "keywords": "k", "extra": 1}),
        json.dumps({"source_id": None, "year": True, "title": None, "authors": {"a": ["x"]}}),
        json.dumps({"source_id": "[x]", "year": "abc", "title": "{y}", "keywords": ["[z]", "{w}"]}),
        '{"source_id":"a","source_id":"b","year":4294967298,"title":"t"}',
    )
    a, b, c, d, e = rows
    assert (a["source_id"], a["year"], a["title"], a["authors"]) == (" s ", 2024, "A b", ["x", "3", "true"])
    assert (b["source_id"], b["year"], b["title"], b["abstract"], b["paper_url"], b["keywords"]) == ("7", 2024, "true", "", "", [])
    assert (c["source_id"], c["year"], c["title"], c["authors"]) == ("", 1, "", [])
    assert (d["source_id"], d["year"], d["title"], d["keywords"]) == ("[x]", 0, "{y}", ["[z]", "{w}"])
    assert (e["source_id"], e["year"]) == ("b", 2)
    assert all(r["reason"] is None for r in rows)


def test_malformed_and_blank(spark):
    rows = parse(spark, "{bad", "", "[1]", "5", "{'source_id':'x'}", None, '{"year":NaN}', '[{"source_id":"x","title":"t"}]', "  ")
    assert [r["reason"] for r in rows] == ["malformed", None, None, None, "malformed", None, "malformed", None, None]
    messages = spark.createDataFrame([(i, v) for i, v in enumerate(["{bad", "", "[1]"])], "seq bigint, value string")
    parsed = ops.parse_events(messages)
    assert ops.valid_events(parsed).count() == 0
    assert [r["seq"] for r in ops.quarantined(parsed).collect()] == [0]
    with pytest.raises(Exception, match="bad message"):
        ops.quarantined(parsed, fail_fast=True).collect()


def test_valid_needs_id_and_title(spark):
    values = [json.dumps({"source_id": s, "title": t}) for s, t in (("a", "t"), (" ", "t"), ("a", " \n"), ("a", " "), ("", "t"))]
    messages = spark.createDataFrame(list(enumerate(values)), "seq bigint, value string")
    assert [r["seq"] for r in ops.valid_events(ops.parse_events(messages)).collect()] == [0]


def test_length_limits(spark):
    values = [json.dumps({"source_id": "s", "title": "t" * n, "keywords": ["k" * m]}) for n, m in ((512, 128), (513, 1), (1, 129))]
    messages = spark.createDataFrame(list(enumerate(values)), "seq bigint, value string")
    checked = ops.check_lengths(ops.parse_events(messages))
    assert [r["reason"] for r in checked.orderBy("seq").collect()] == [None, "too long: title", "too long: keywords"]


def test_counters_drift_until_rebuilt(spark):
    events = spark.createDataFrame([(1, "a", 2021, [], [], ["x"]), (2, "a", 2022, [], [], ["x", "y"])], EVENT)
    firsts = ops.first_events(events)
    assert ops.year_deltas(firsts).collect() == [(2021, 1)]
    assert ops.value_deltas(firsts, "keywords").collect() == [("x", 1)]
    assert ops.latest_events(events).head()["year"] == 2022
    assert sorted(r["value"] for r in ops.dimension_rows(events, "keywords").collect()) == ["x", "y"]


def test_double_increment_under_collation(spark):
    events = spark.createDataFrame([(1, "a", 2021, [], [], ["Deep", "deep"])], EVENT)
    collation = "UNICODE_CI_AI_RTRIM"
    assert ops.dimension_rows(events, "keywords", collation=collation).count() == 1
    assert [r["paper_count"] for r in ops.value_deltas(events, "keywords", collation).collect()] == [2]


def test_all_rows_forms_agree(spark):
    events = spark.createDataFrame([(i, f"s{i % 3}", 2000 + i, [f"a{i}", " "], ["l"], [f"k{i % 2}"]) for i in range(6)], EVENT)
    every = ops.all_dimension_rows(events)
    for name in ("authors", "institutions", "keywords"):
        want = sorted(tuple(r) for r in ops.dimension_rows(events, name).select("source_id", "value").collect())
        assert sorted(tuple(r) for r in every.where(F.col("dimension") == name).select("source_id", "value").collect()) == want
    counted = {(r["counter"], r["value"]): r["paper_count"] for r in ops.all_deltas(events).collect()}
    assert counted[("yearly", "2000")] == 1 and counted[("institutions", "l")] == 6 and ("authors", " ") not in counted


def test_upsert_merge(spark):
    early = F.lit("2025-01-01").cast("timestamp")
    stored = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021), (3, "c", None)], "id bigint, source_id string, year int")
    stored = stored.withColumn("created_at", early).withColumn("updated_at", early)
    batch = spark.createDataFrame([(9, "a", 2020), (8, "b", 2022), (7, "d", 2023), (6, "c", 1)], "id bigint, source_id string, year int")
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r["source_id"]: r for r in ops.upsert_merge(stored, batch, now, ["year"]).collect()}
    assert {k: (r["id"], r["year"], r["created_at"].year, r["updated_at"].year) for k, r in got.items()} == {
        "a": (1, 2020, 2025, 2025), "b": (2, 2022, 2025, 2026), "c": (3, 1, 2025, 2026), "d": (7, 2023, 2026, 2026)}


def test_insert_absent(spark):
    old = spark.createDataFrame([("a", "x")], "source_id string, value string")
    new = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "source_id string, value string")
    assert sorted(tuple(r) for r in insert_absent(old, new, ["source_id", "value"]).collect()) == [("a", "x"), ("a", "y")]


def test_halves_are_not_merged_in_one_task(spark):
    from quillstream.plans.ingest_queries import _later
    for seqs in ([5, 1, 9, 7], [3, 1, 2], [4, 4, 1, 4], [8], []):
        df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
        found = df.where(_later(df))
        assert "median" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "percentile" not in plan
        middle = df.agg(F.median("seq")).first()[0]
        assert sorted(r["seq"] for r in found.collect()) == sorted(s for s in seqs if s >= middle)


def test_sketches_of_a_batch_need_no_distinct_rows(spark, tmp_path, monkeypatch):
    from quillstream.streaming import ingest
    from quillstream.streaming.tables import BatchTables
    frames = {}
    original = BatchTables.publish
    monkeypatch.setattr(BatchTables, "publish", lambda self, source, batch, made: (frames.update(made), original(self, source, batch, made))[1])
    rows = [(i, '{"source_id": "s%d", "title": "t", "year": 2001, "authors": ["a%d"]}' % (i % 7, i % 5)) for i in range(40)] + [(40, "{broken")]
    tables = BatchTables(spark, str(tmp_path))
    ingest.load_batch(tables, spark.createDataFrame(rows, "seq bigint, value string"), "job", 0)
    plan = frames["sketches"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [dimension" not in plan and "Generate" in plan
    assert tables.summary().first()["authors"] == 5 and [tuple(r) for r in tables.quarantine().collect()] == [(40, "{broken", "malformed")]

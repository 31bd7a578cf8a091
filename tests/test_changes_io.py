"""Change log, polling, files and message sinks."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.operators import changes
from quillstream.operators.records import to_messages
from quillstream.session import shared_dir, spread
from quillstream.sinks.messages import append_seen, publish_dry_run
from quillstream.sources.files import read_json_records, read_seen
from quillstream.streaming import feed


def test_change_rows_and_projection(spark):
    full = ["7", "s", "2024", "t", None, "u", "p", "skip", "2026-01-01 00:00:00", "bad"]
    log = spark.createDataFrame([
        (1, "db", "papers", "insert", 0, full), (2, "db", "papers", "update", 0, full), (2, "db", "papers", "update", 1, full),
        (3, "db", "papers", "delete", 0, full), (4, "db", "other", "insert", 0, full), (5, "x", "papers", "insert", 0, full),
        (6, "db", "papers", "insert", 0, full[:9]), (7, "db", "papers", "insert", 0, ["x", None, "y"] + full[3:])],
        "seq int, schema_name string, table_name string, op string, row_index int, image array<string>")
    now = F.lit("2026-02-02 00:00:00").cast("timestamp")
    rows = {r["seq"]: r for r in changes.project_images(changes.change_rows(log, "db", "papers"), now).collect()}
    assert sorted(rows) == [1, 2, 7]
    assert (rows[1]["id"], rows[1]["abstract"], rows[1]["created_at"], rows[1]["updated_at"]) == (7, "", datetime(2026, 1, 1), datetime(2026, 2, 2))
    assert (rows[7]["id"], rows[7]["source_id"], rows[7]["year"]) == (0, "", 0)
    assert [r["seq"] for r in changes.change_rows(log, "db", "papers", start=6).collect()] == [7]
    event = json.loads(feed.log_events(log, "db", "papers", now).where("seq = 1").head()["event"])
    assert event["type"] == "paper.updated" and event["payload"]["source_id"] == "s" and "crawled_at" not in event["payload"]


def test_polling_keeps_ties(spark):
    at = datetime(2026, 1, 2)
    rows = spark.createDataFrame([(i, at) for i in range(60)], "id bigint, updated_at timestamp")
    assert changes.updated_after(rows, F.lit(datetime(2026, 1, 1)), limit=50).count() == 50
    assert changes.updated_after(rows, F.lit(at), limit=50).count() == 0
    cursor, got = feed.initial_cursor(at), []
    for _ in range(3):
        events, cursor = feed.poll(rows, cursor)
        got += [json.loads(r["event"])["payload"]["id"] for r in events.collect()]
    assert sorted(got) == list(range(60)) and cursor == (at, 59)


RECORD = "source_id string, year int, title string, authors array<string>"


def test_json_files(spark, tmp_path):
    records = [{"source_id": "a", "year": 1, "title": "é", "authors": ["x"], "other": 2}, {"source_id": "b", "title": "t"}]
    lines, array = tmp_path / "r.jsonl", tmp_path / "r.json"
    lines.write_text("\n" + "\n\n".join(json.dumps(r, ensure_ascii=False) for r in records) + "\n")
    array.write_text("\n  " + json.dumps(records, indent=1))
    for path in (lines, array):
        got = sorted(tuple(r) for r in read_json_records(spark, str(path), RECORD).collect())
        assert got == [("a", 1, "é", ["x"]), ("b", None, "t", None)]


def test_messages_and_seen(spark, tmp_path):
    papers = spark.createDataFrame([("a", 1, "é", ["x"]), ("b", None, "t", None)], RECORD)
    row = to_messages(papers).where("key = 'b'").head()
    assert json.loads(row["value"]) == {"source_id": "b", "year": None, "title": "t", "authors": None}
    assert "é" in to_messages(papers).where("key = 'a'").head()["value"]
    publish_dry_run(papers, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert "\n" in to_messages(papers, pretty=True).head()["value"]
    append_seen(papers, str(tmp_path / "seen"))
    append_seen(papers.limit(1), str(tmp_path / "seen"))
    assert read_seen(spark, str(tmp_path / "seen")).count() == 3


def test_shared_dir_follows_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert shared_dir(spark, "x").startswith(base)


def test_spread_leaves_large_inputs(spark, monkeypatch):
    df = spark.range(10)
    assert spread(df, "id").rdd.getNumPartitions() == 8
    monkeypatch.setattr("quillstream.session.SPREAD_BYTES_PER_CORE", 0)
    assert spread(df, "id") is df


def test_negative_limit(spark):
    with pytest.raises(ValueError):
        changes.updated_after(spark.createDataFrame([], "id bigint, updated_at timestamp"), F.lit(None), limit=-1)


def test_large_year_and_repeated_ids(spark):
    from quillstream.operators.changes import updated_after
    from quillstream.operators.search import search_after
    papers = spark.range(120).select((F.col("id") % 40).alias("id"), F.concat(F.lit("s"), F.col("id")).alias("source_id"), F.lit(2024).alias("year"), F.lit("t").alias("title"),
                                     F.lit("a").alias("abstract"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"))
    seen, last = [], (9999, 0, "")
    while page := search_after(papers, last[0], last[1], limit=7, after_key=last[2]).collect():
        seen += [r["source_id"] for r in page]
        last = (page[-1]["year"], page[-1]["id"], page[-1]["source_id"])
    assert len(seen) == 120 == len(set(seen))
    seen, last = [], ("2000-01-01", -1, "")
    while page := updated_after(papers, F.lit(last[0]).cast("timestamp"), F.lit(last[1]), 7, F.lit(last[2])).collect():
        seen += [r["source_id"] for r in page]
        last = (page[-1]["updated_at"], page[-1]["id"], page[-1]["source_id"])
    assert len(seen) == 120 == len(set(seen))


def test_pages_and_polls_over_one_id(spark):
    from quillstream.operators.search import search_after, search_page
    papers = spark.range(50).select(F.lit(7).cast("bigint").alias("id"), F.concat(F.lit("s"), F.col("id")).alias("source_id"), F.lit(2024).alias("year"), F.lit("t").alias("title"),
                                    F.lit("a").alias("abstract"), F.lit("2026-01-01").cast("timestamp").alias("updated_at")).repartition(8)
    cursor, got = (datetime(2025, 12, 31), -1), []
    for _ in range(4):
        events, cursor = feed.poll(papers, cursor, 20)
        got += [json.loads(r["event"])["payload"]["source_id"] for r in events.collect()]
    assert len(got) == 50 == len(set(got)) and feed.poll(papers, cursor, 20)[1] == cursor
    expected = sorted((f"s{i}" for i in range(50)), reverse=True)
    for deep in (0, 10_000):
        seen = [r["source_id"] for r in search_page(papers, limit=20, deep_page=deep).collect()]
        assert seen + [r["source_id"] for r in search_after(papers, 2024, 7, limit=50, after_key=seen[-1]).collect()] == expected
        assert [r["source_id"] for r in search_page(papers, limit=20, offset=20, deep_page=deep).collect()] == expected[20:40]


def test_long_polls_are_not_brought_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr("quillstream.operators.ranks.LISTED", 100)
    rows = spark.range(3000).select((F.col("id") % 2).alias("id"), F.concat(F.lit("s"), 10_000 + F.col("id")).alias("source_id"),
                                    F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(F.col("id") / 500)).alias("updated_at"))
    cursor, got = (datetime(2025, 12, 31), -1), []
    while True:
        events, after = feed.poll(rows, cursor, 1300)
        assert "LocalRelation" not in events._jdf.queryExecution().optimizedPlan().toString()
        page = [json.loads(r["event"])["payload"]["source_id"] for r in events.collect()]
        if after == cursor:
            break
        # nothing stays behind: all that is sent comes before what follows
        assert len(page) == min(1300, 3000 - len(got))
        got, cursor = got + page, after
    assert not page and len(got) == 3000 == len(set(got))

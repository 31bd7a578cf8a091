"""Stream equals batch, replays add nothing, half-written batches stay unseen."""

import json
import os
import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ingest as ops
from quillstream.sources.messages import file_stream, numbered, text_stream
from quillstream.streaming import state
from quillstream.streaming import ledger
from quillstream.streaming.ingest import load_batch, start_ingest
from quillstream.streaming.ledger import unseen
from quillstream.streaming.tables import BatchTables
from quillstream.plans.dashboard import dashboard, stored_tables

AT = datetime(2026, 1, 1, tzinfo=timezone.utc)
ONCE = {"availableNow": True}


def messages(n=120, seed=5):
    """Repeated ids with changing years and lists; one id holds a third of them."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        sid = "hot" if rng.random() < 0.34 else f"s{rng.randint(0, 15)}"
        out.append((seq, json.dumps({
            "source_id": sid, "year": 2000 + rng.randint(0, 5), "title": f"T {seq % 4}",
            "authors": [f"a{rng.randint(0, 4)}" for _ in range(3)], "keywords": [f"k{rng.randint(0, 6)}"],
            "institutions": ["lab"], "crawled_at": "2026-01-01T00:00:00Z"})))
    out[7] = (7, "{broken")
    return out


def write(spark, folder, rows, files):
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], "seq bigint, value string")
        part.coalesce(1).write.parquet(f"{folder}/part{i:02d}")


def state_of(tables):
    def rows(df):
        return sorted(tuple(r) for r in df.collect())
    papers = tables.papers().select("id", "source_id", "year", "title")
    return rows(papers), rows(tables.all_counters()), rows(tables.dimension("authors")), rows(tables.ledger().select("source_id", "first_seq"))


def expected(rows):
    """Plain one-by-one load."""
    papers, first, counters, dims = {}, {}, {}, set()
    for seq, value in rows:
        try:
            e = json.loads(value)
        except ValueError:
            continue
        sid = e["source_id"]
        lists = {f: list(dict.fromkeys(e[f])) for f in ("authors", "institutions", "keywords")}
        papers[sid] = (first.get(sid, seq), sid, e["year"], e["title"])
        dims |= {(sid, a) for a in lists["authors"]}
        if sid not in first:
            first[sid] = seq
            for key in [("yearly", str(e["year"]))] + [(f, v) for f, vs in lists.items() for v in vs]:
                counters[key] = counters.get(key, 0) + 1
    return (sorted(papers.values()), sorted((*k, n) for k, n in counters.items()), sorted(dims), sorted(first.items()))


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_plain_load(spark, tmp_path, files):
    rows = messages()
    write(spark, tmp_path / "in", rows, files)
    tables = BatchTables(spark, str(tmp_path / "tables"))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), max_files=1)
    start_ingest(stream, tables, str(tmp_path / "cp"), ONCE, lambda _: AT).awaitTermination()
    assert tables.last_committed() == files - 1
    assert state_of(tables) == expected(rows)
    assert [r["reason"] for r in tables.quarantine().collect()] == ["malformed"]

    # Started again nothing is new; from a fresh checkpoint everything is re-read.
    start_ingest(stream, tables, str(tmp_path / "cp"), ONCE, lambda _: AT).awaitTermination()
    assert tables.last_committed() == files - 1
    start_ingest(stream, tables, str(tmp_path / "cp2"), ONCE, lambda _: AT).awaitTermination()
    assert tables.last_committed() == 2 * files - 1
    assert state_of(tables)[1:] == expected(rows)[1:]

    if files == 4:
        folded = tables.fold_into(str(tmp_path / "folded"))
        assert state_of(folded) == state_of(tables)
        assert folded.is_loaded(str(tmp_path / "cp"), files - 1) and not folded.is_loaded(str(tmp_path / "cp"), files)
        board = dashboard(stored_tables(folded))
        assert sum(r["count"] for r in board["yearly"].collect()) == len(expected(rows)[0])


def test_failed_batch_is_invisible_and_retried(spark, tmp_path, monkeypatch):
    rows = messages(60)
    frame = spark.createDataFrame(rows, "seq bigint, value string")
    tables = BatchTables(spark, str(tmp_path))
    load_batch(tables, frame.where("seq < 20"), "job", 0, AT)
    before = state_of(tables)

    def stop(*_):
        raise RuntimeError("lost before the commit row")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_commit", stop)
        with pytest.raises(RuntimeError):
            load_batch(tables, frame.where("seq >= 20"), "job", 1, AT)
    assert state_of(tables) == before
    assert load_batch(tables, frame.where("seq >= 20"), "job", 1, AT)
    assert not load_batch(tables, frame.where("seq >= 20"), "job", 1, AT)
    assert state_of(tables) == expected(rows)


def test_updated_at_moves_only_on_change(spark, tmp_path):
    tables = BatchTables(spark, str(tmp_path))

    def send(seq, day, title):
        value = json.dumps({"source_id": "a", "title": title, "year": 1, "crawled_at": "2026-01-01T00:00:00Z"})
        frame = spark.createDataFrame([(seq, value)], "seq bigint, value string")
        load_batch(tables, frame, "job", seq, datetime(2026, 1, day, tzinfo=timezone.utc))

    for seq, (day, title) in enumerate([(1, "x"), (2, "y"), (3, "y")]):
        send(seq, day, title)
    row = tables.papers().head()
    assert (row["title"], row["created_at"].day, row["updated_at"].day) == ("y", 1, 2)


def test_unseen_both_ways(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, n int").persist()
    ledger = spark.createDataFrame([("b",), ("b",), ("z",)], "source_id string")
    for limit in (1 << 20, 0):
        assert [r["source_id"] for r in unseen(keys, ledger, limit=limit).collect()] == ["a"]


def test_state_operators(spark, tmp_path):
    rows = [(i, f"s{i % 5}", [f"v{i % 5}", "all"]) for i in range(20)]
    for i in range(2):
        part = spark.createDataFrame(rows[i * 10:(i + 1) * 10] + rows[:3], "seq bigint, source_id string, values array<string>")
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = file_stream(spark, str(tmp_path / "in" / "*"), schema="seq bigint, source_id string, values array<string>", max_files=1)
    query, tables = state.start_upserts(state.running_counts(stream, "values"), spark, str(tmp_path / "c"), str(tmp_path / "ccp"))
    query.awaitTermination()
    assert dict(state.current_state(tables, ["value"]).select("value", "paper_count").collect()) == {**{f"v{i}": 1 for i in range(5)}, "all": 5}
    with pytest.raises(ValueError):
        tables.fold_into(str(tmp_path / "none"))
    folded = state.fold_state(tables, str(tmp_path / "folded"), ["value"])
    assert folded.read("state").count() == 6
    assert folded.is_loaded(str(tmp_path / "ccp"), 0)
    assert sorted(state.current_state(folded, ["value"]).collect()) == sorted(state.current_state(tables, ["value"]).collect())
    query, tables = state.start_upserts(stream.select("source_id", "seq"), spark, str(tmp_path / "u"), str(tmp_path / "ucp"),
                                        keys=["source_id"], order=["seq"])
    query.awaitTermination()
    assert tables.read("state").count() == 10
    assert dict(state.current_state(tables, ["source_id"], ["seq"]).collect()) == {f"s{i}": 15 + i for i in range(5)}
    query, tables = state.start_upserts(state.first_seen(stream), spark, str(tmp_path / "f"), str(tmp_path / "fcp"))
    query.awaitTermination()
    assert dict(state.current_state(tables, ["source_id"]).collect()) == {f"s{i}": i for i in range(5)}


def test_lines_of_text_files_arrive_in_order(spark, tmp_path):
    """Two files of one time and a later one: every line has a place of its own, and the last line of an id counts."""
    lines = {"a.txt": [("x", i) for i in range(500)] + [("y", 1)], "b.txt": [("y", 2), ("z", 1), ("z", 2)], "c.txt": [("x", 999)]}
    (tmp_path / "in").mkdir()
    for name, rows in lines.items():
        file = tmp_path / "in" / name
        file.write_text("".join(json.dumps({"source_id": k, "title": f"t{i}", "year": i, "crawled_at": "2026-01-01T00:00:00Z"}) + "\n" for k, i in rows))
        os.utime(file, (1_700_000_000 + (name == "c.txt"),) * 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several blocks a file
    try:
        for files in (None, 1):
            tables = BatchTables(spark, str(tmp_path / f"t{files}"))
            start_ingest(text_stream(spark, str(tmp_path / "in"), max_files=files), tables, str(tmp_path / f"cp{files}"), ONCE, lambda _: AT).awaitTermination()
            papers = {r["source_id"]: (r["id"], r["year"]) for r in tables.papers().collect()}
            # files of one time in different batches come in either order
            assert papers.pop("y")[1] in ((2,) if files is None else (1, 2))
            assert {k: v[1] for k, v in papers.items()} == {"x": 999, "z": 2}
            if files is None:
                assert papers["x"][0] == 0 and papers["z"][0] == 502
        frame = spark.read.text(str(tmp_path / "in")).select(
            F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        seqs = [(r["seq"], json.loads(r["value"])["year"]) for r in numbered(frame, 2).orderBy("seq").collect()]
        assert [s for s, _ in seqs] == list(range(2 << 44, (2 << 44) + 505))
        assert [y for _, y in seqs] == [i for rows in lines.values() for _, i in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folded_ledger_is_looked_up_in_few_buckets(spark, tmp_path):
    def send(tables, ids, batch):
        rows = [(i, json.dumps({"source_id": f"id-{i}", "title": "t", "year": 1, "crawled_at": "2026-01-01T00:00:00Z"})) for i in ids]
        load_batch(tables, spark.createDataFrame(rows, "seq bigint, value string"), "job", batch, AT)

    tables = BatchTables(spark, str(tmp_path / "a"))
    send(tables, range(0, 3000), 0)
    send(tables, range(2000, 5000), 1)
    folded = tables.fold_into(str(tmp_path / "b"))
    assert folded.read("ledger").count() == 0 and folded.read("ledger_base").count() == 5000
    assert sorted(folded.ledger().collect()) == sorted(tables.ledger().collect())
    # a second fold keeps the first one's ids
    send(folded, range(4990, 5010), 2)
    assert dict(folded.all_counters().select("counter", "paper_count").collect())["yearly"] == 5010
    again = folded.fold_into(str(tmp_path / "c"))
    assert again.read("ledger_base").count() == 5010

    stored = again.stored_ledger()
    keys = spark.createDataFrame([("id-7",), ("id-4999",), ("id-5005",)] + [(f"new-{i}",) for i in range(40)], "source_id string").persist()
    known = stored.known(keys)
    plan = known._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "source_id#" in line and "bucket#" in line]
    assert scans and all(re.search(r"PartitionFilters: \[.*bucket#\d+ IN|INSET", line) for line in scans), plan
    # the ledger stays where it is: what is exchanged is the matches, after the broadcast join
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["source_id"] for r in known.collect()} == {"id-7", "id-4999", "id-5005"}
    buckets = {r[0] for r in ledger.maybe_known(keys, stored.bloom).select("bucket").collect()}
    assert len(buckets) < 8
    assert stored.base.where(F.col("bucket").isin(list(buckets))).count() < 5010 / 6
    assert {r["source_id"] for r in stored.unseen(keys).collect()} == {f"new-{i}" for i in range(40)}
    assert stored.known(spark.createDataFrame([("never",)], "source_id string")) is None


def test_filters_pass_what_they_hold_and_little_else(spark):
    ids = spark.range(60_000).select(F.concat(F.lit("p"), F.col("id")).alias("source_id"))
    bloom = ledger.filters(ids, buckets=4).persist()
    assert bloom.select("segments").distinct().collect()[0][0] == 5
    assert ledger.maybe_known(ids, bloom, buckets=4).count() == 60_000
    others = spark.range(60_000).select(F.concat(F.lit("q"), F.col("id")).alias("source_id"))
    assert ledger.maybe_known(others, bloom, buckets=4).count() < 1_800
    bloom.unpersist()


def test_folded_records_are_read_by_year_and_kept_current(spark, tmp_path):
    def send(tables, rows, batch, day):
        made = [(s, json.dumps({"source_id": k, "title": t, "year": y, "crawled_at": "2026-01-01T00:00:00Z"})) for s, k, t, y in rows]
        load_batch(tables, spark.createDataFrame(made, "seq bigint, value string"), "job", batch, datetime(2026, 1, day, tzinfo=timezone.utc))

    plain, folding = BatchTables(spark, str(tmp_path / "plain")), BatchTables(spark, str(tmp_path / "f0"))
    batches = [[(i, f"p{i}", "t", 2000 + i % 4) for i in range(40)], [(100, "p1", "new", 2001), (101, "p2", "t", 2002), (102, "q", "t", 2001)],
               [(200, "p1", "new", 2009), (201, "p5", "t", 2001)], [(300, "q", "late", None)]]
    for k, rows in enumerate(batches):
        for tables in (plain, folding):
            send(tables, rows, k, k + 1)
        got = folding.papers()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.papers().select(*got.columns).collect()))
        if k < 3:
            folding = folding.fold_into(str(tmp_path / f"f{k + 1}"))
            assert folding.read("papers").count() == 0
            got = folding.papers()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.papers().select(*got.columns).collect()))
    assert sorted(r["source_id"] for r in folding.papers().where("year = 2009").collect()) == ["p1"]
    plan = folding.papers().where("year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = 2001", plan)

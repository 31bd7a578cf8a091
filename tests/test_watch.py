"""A change watcher: cursor in the checkpoint, fallback from the log, nothing lost or repeated."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.sources.change_table import ChangeReader, change_stream
from quillstream.sources.messages import file_stream
from quillstream.streaming.feed import ChangeWatcher

ONCE = {"availableNow": True}
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "id bigint, source_id string, title string, updated_at timestamp"


def table(spark, folder, part, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.option("parquet.block.size", "1024").parquet(f"{folder}/part={part}")


def rows_at(second, keys, ids=(1, 1, 2)):
    return [(i, f"{k}-{n}", f"t{second}", T0 + timedelta(seconds=second)) for k in keys for n, i in enumerate(ids)]


def sent(watcher):
    return sorted((json.loads(r["event"])["payload"]["source_id"], r["updated_at"].second) for r in watcher.events().collect())


def expected(rows):
    return sorted((r[1], r[3].second) for r in rows)


def stream(spark, folder, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return lambda: change_stream(spark, folder, schema, T0 - timedelta(days=1), **options)


def test_restarts_neither_lose_nor_repeat(spark, tmp_path, monkeypatch):
    folder, everything = str(tmp_path / "t"), []
    for run in range(3):
        # each time more rows share a time, and an id, with rows sent before
        rows = rows_at(run, [f"{run}a"]) + rows_at(run + 1, [f"{run}b"] if run == 2 else [])
        everything += rows
        table(spark, folder, run, rows)
        # a new watcher knows nothing but its folders
        watcher = ChangeWatcher(spark, str(tmp_path / "w"))
        assert watcher.run(None, stream(spark, folder), ONCE) == "poll"
        assert sent(watcher) == expected(everything)
    assert watcher.run(None, stream(spark, folder), ONCE) == "poll"
    assert sent(watcher) == expected(everything)

    # a batch that is lost before its commit is sent by the next start
    more = rows_at(9, ["late"])
    table(spark, folder, 9, more)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(watcher.tables, "_commit", stop)
        with pytest.raises(Exception, match="lost"):
            watcher.run(None, stream(spark, folder), ONCE)
    assert sent(watcher) == expected(everything)
    watcher = ChangeWatcher(spark, str(tmp_path / "w"))
    watcher.run(None, stream(spark, folder), ONCE)
    assert sent(watcher) == expected(everything + more)


def test_polling_takes_over_from_a_log_that_fails(spark, tmp_path):
    early, late = rows_at(1, "ab"), rows_at(2, "cd")
    folder = str(tmp_path / "t")
    table(spark, folder, 0, early + late)
    table(spark, str(tmp_path / "log"), 0, early)

    def log():
        return file_stream(spark, str(tmp_path / "log" / "*"), schema=SCHEMA, max_files=1)

    watcher = ChangeWatcher(spark, str(tmp_path / "w"))
    assert watcher.run(log, stream(spark, folder), ONCE) == "log"
    assert sent(watcher) == expected(early)
    # the log breaks off in its next file
    broken = tmp_path / "log" / "part=1"
    broken.mkdir()
    (broken / "x.parquet").write_bytes(b"not a table")
    with pytest.warns(UserWarning, match="polling"):
        assert watcher.run(log, stream(spark, folder), ONCE) == "poll"
    assert sent(watcher) == expected(early + late)
    assert {r["via"] for r in watcher.events().collect()} == {"log", "poll"}
    with pytest.warns(UserWarning, match="polling"):
        watcher.run(log, stream(spark, folder), ONCE)
    assert sent(watcher) == expected(early + late)


def test_offsets_and_parts(spark, tmp_path):
    folder = str(tmp_path / "t")
    now = datetime.now(timezone.utc)
    rows = rows_at(1, "ab") + [(None, None, "no keys", T0 + timedelta(seconds=1)), (3, "x", "no time", None), (4, "new", "unsettled", now + timedelta(hours=1))]
    table(spark, folder, 0, rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("updated_at", F.to_timestamp_ntz(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")))
    frame.coalesce(1).write.parquet(f"{folder}/part=1")
    options = {"path": folder, "after": "0", "settle": "1"}
    reader = ChangeReader(spark.createDataFrame([], SCHEMA).schema, options)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"updated_at": int(T0.timestamp() + 1) * 10**6, "id": 2, "source_id": "b-2"}
    got = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 14 and {r["source_id"] for r in got} == {f"{k}-{n}" for k in "ab" for n in range(3)} | {None}
    for path in (f"file://{folder}", f"file:{folder}"):
        assert ChangeReader(reader.columns, dict(options, path=path)).latestOffset() == end
    # between two places of one time, and nothing behind the last
    middle = dict(end, id=1, source_id="a-1")
    between = [r["source_id"] for p in reader.partitions(middle, end) for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(between) == sorted(["b-0", "b-1", "a-2", "b-2"] * 2)
    assert not [r for p in reader.partitions(end, end) for b in reader.read(p) for r in b.to_pylist()]
    # a table without rows, and one whose rows have not settled, send nothing
    empty = ChangeReader(reader.columns, dict(options, path=str(tmp_path)))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    empty.path = str(tmp_path / "none")
    assert empty.latestOffset() == empty.initialOffset()
    with pytest.raises(Exception, match="source_id"):
        change_stream(spark, folder, spark.createDataFrame([], "id bigint, updated_at timestamp").schema)

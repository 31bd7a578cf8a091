"""First rows of groups and pages, by rank, over keys of several types."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ranks
from quillstream.operators.perkey import GROUP_LIMIT_BOUND, first_n_per_group
from quillstream.operators.ranks import by
from quillstream.operators.search import search_page


def least(value):
    return (value is not None, value)


def table(spark, n=3000):
    """One group holds two thirds; keys of every type are null now and then, and some repeat."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        group = rng.choice(["a", "a", None, "b", "a", "a"])
        word = None if rng.random() < 0.01 else "order-" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        rows.append((i, group, word, rng.randint(-50, 50) if rng.random() < 0.98 else None, datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 10**6)), "x"))
    return spark.createDataFrame(rows, "n int, g string, word string, small int, at timestamp_ntz, _take string"), rows


def firsts(rows, columns, n):
    out = []
    for g in {r[1] for r in rows}:
        out += sorted((r for r in rows if r[1] == g), key=lambda r: [least(r[c]) for c in columns])[:n]
    return out


@pytest.mark.parametrize("n", [1, GROUP_LIMIT_BOUND, GROUP_LIMIT_BOUND + 1, 1500, 5000])
@pytest.mark.parametrize("order", [["word", "n"], ["at", "n"], ["n"]])
def test_first_n_of_any_type(spark, n, order):
    df, rows = table(spark)
    at = [df.columns.index(c) for c in order]
    got = [tuple(r) for r in first_n_per_group(df, "g", order, n).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(firsts(rows, at, n), key=lambda r: r[0])


def test_ties_are_split_and_ranges_cut_again(spark, monkeypatch):
    df, rows = table(spark)
    monkeypatch.setattr(ranks, "RANKED", 20)
    monkeypatch.setattr(ranks, "SAMPLE", 40)
    monkeypatch.setattr(ranks, "BOUNDS", 4)
    for n in (7, 400, 1234):
        got = ranks.first_n(df, ["g"], by("small"), n).select("g", "small").collect()
        want = [(r[1], r[3]) for r in firsts(rows, [3], n)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        got = ranks.first_n(df, ["g"], by("word", "n"), n).select("n").collect()
        assert {r["n"] for r in got} == {r[0] for r in firsts(rows, [2, 0], n)}


def test_pages_neither_lose_nor_repeat(spark):
    df, rows = table(spark, 400)
    order = [*by("small", descending=True), *by("g")]
    seen = []
    for offset in range(0, 450, 50):
        got = [tuple(r) for r in ranks.page(df, order, offset, 50).collect()]
        assert len(got) == min(50, 400 - offset) if offset < 400 else not got
        seen += got
    assert sorted(seen, key=lambda r: r[0]) == rows
    keys = [(r[3], r[1]) for r in seen]
    want = sorted(((r[3], r[1]) for r in rows), key=lambda k: (k[0] is None, -(k[0] or 0), least(k[1])))
    assert keys == want


def test_text_ids_on_both_sides_of_the_switch(spark):
    rows = [(2000 + i % 3, f"id-{i * 7919 % 500:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "year int, id string")
    want = sorted(rows, reverse=True)[120:140]
    for deep_page in (0, 1_000):
        assert [tuple(r) for r in search_page(df, limit=20, offset=120, deep_page=deep_page).collect()] == want


def test_rows_are_read_twice_and_stay_where_they_are(spark, tmp_path, monkeypatch):
    df, _ = table(spark)
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    plans = []
    original = ranks.stored

    def kept(frame, purpose):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return original(frame, purpose)

    monkeypatch.setattr(ranks, "stored", kept)
    out = ranks.first_n(df, ["g"], by("word", "n"), 1500)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    reads = sum(len(re.findall(rf"FileScan parquet.*{re.escape(str(tmp_path))}", p)) for p in plans)
    assert reads == 2
    assert "Exchange hashpartitioning" not in plans[-1] and "BroadcastHashJoin" in plans[-1]


def test_bounds(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    assert ranks.first_n(df, [], by("k"), 3).count() == 3
    assert ranks.page(df, by("k"), 10, 5).count() == 0 and ranks.page(df.limit(0), by("k"), 0, 5).count() == 0
    nth = ranks.nth_keys(df, [], by("k"), 5).first()
    assert (nth["k"], nth["take"], nth["copies"]) == (4, 1, 1)
    assert df.where(ranks.precedes([F.col("k")], [F.lit(2)], by("k", descending=True))).count() == 2


@pytest.mark.parametrize("listed", [0, 1 << 12])
def test_long_pages_are_cut_out_between_keys(spark, monkeypatch, listed):
    df, rows = table(spark, 400)
    monkeypatch.setattr(ranks, "LISTED", listed)
    for order in ([*by("small", descending=True), *by("g")], by("g"), by("n")):
        seen = []
        for offset in (0, 40, 130, 170, 390):
            until = {0: 40, 40: 130, 130: 170, 170: 390, 390: 450}[offset]
            got = [tuple(r) for r in ranks.page(df, order, offset, until - offset).collect()]
            assert len(got) == min(until, 400) - offset
            seen += got
        assert sorted(seen, key=lambda r: r[0]) == rows


def test_no_task_merges_a_long_page(spark, monkeypatch):
    from quillstream.operators.search import search_after
    monkeypatch.setattr(ranks, "LISTED", 50)
    df = spark.range(3000).selectExpr("id", "cast(id % 3 as int) as year", "concat('s', id) as source_id")
    found = search_after(df, 2, 10, limit=1200, after_key="s10")
    assert "TakeOrderedAndProject" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SinglePartition" not in plan
    want = sorted(((i % 3, i) for i in range(3000) if (i % 3, i) < (2, 10)), reverse=True)[:1200]
    assert [(r["year"], r["id"]) for r in found.collect()] == want

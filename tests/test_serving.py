"""Rankings, totals, fallbacks, search and paging on the demo records."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import search, stats
from quillstream.operators.ingest import dimension_rows
from quillstream.plans.dashboard import dashboard
from quillstream.sources.demo import demo_papers

COLLATION = "UNICODE_CI_AI_RTRIM"


@pytest.fixture(scope="module")
def demo(spark):
    papers = demo_papers(spark, F.lit("2026-01-01").cast("timestamp")).withColumn("id", F.xxhash64("source_id"))
    dims = {name: dimension_rows(papers, name).cache() for name in ("authors", "institutions", "keywords")}
    return {"papers": papers.cache(), **dims}


def empty_points(spark):
    return spark.createDataFrame([], "name string, value bigint")


def test_demo_dashboard(spark, demo):
    tables = dict(demo, stats_yearly=spark.createDataFrame([], "year int, count bigint"),
                  **{f"stats_{n}": empty_points(spark) for n in ("authors", "institutions", "keywords")})
    board = dashboard(tables, q="detection")
    assert [tuple(r) for r in board["yearly"].collect()] == [(2021, 2), (2022, 2), (2023, 2), (2024, 2)]
    assert [r["year"] for r in board["years"].collect()] == [2024, 2023, 2022, 2021]
    assert tuple(board["summary"].head()) == (8, 4, 18, 16, 9)
    assert tuple(board["figures"].head()) == (8, "4", "2021-2024", 43)
    assert [tuple(r) for r in board["keywords"].limit(5).collect()] == [
        ("foundation model", 2), ("object detection", 2), ("representation learning", 2),
        ("semantic segmentation", 2), ("video understanding", 2)]
    assert [r["name"] for r in board["authors"].limit(3).collect()] == ["Alice Zhang", "Bob Wang", "Chen Li"]
    assert board["papers"].count() == 3
    assert board["papers_meta"].head()["range_text"] == "1-3 / 3"
    assert search.search_total(demo["papers"], year=2022).head()[0] == 2


def test_figures_without_stored_totals(spark):
    yearly = spark.createDataFrame([(2021, 2), (2024, 3)], "year int, count bigint")
    zero = spark.createDataFrame([(0, 0, 0, 0, 0)], "papers bigint, years bigint, keywords bigint, authors bigint, institutions bigint")
    assert tuple(stats.dashboard_kpis(yearly, zero).head()) == (5, "2021-2024", "2021-2024", 0)
    assert tuple(stats.dashboard_kpis(yearly.where("year < 0"), zero).head()) == (0, "0", "0", 0)


def test_stored_first_then_detail(spark, demo):
    stored = spark.createDataFrame([("stored", 9)], "name string, value bigint")
    for probe in (False, True):
        assert stats.with_fallback(stored, stats.value_counts(demo["authors"]), probe).collect() == [("stored", 9)]
        assert stats.with_fallback(empty_points(spark), stats.value_counts(demo["authors"]), probe).count() == 16
    only_stopwords = spark.createDataFrame([("the", 9), ("Model", 8)], "name string, value bigint")
    assert stats.ranked_keywords(only_stopwords, demo["keywords"], 3).count() == 3


def test_overfetch_can_fall_short(spark):
    points = spark.createDataFrame([(w, 10) for w in ("a", "an", "and", "the", "we")] + [("gear", 1)], "name string, value bigint")
    assert stats.top_keywords(points, 1).collect() == []
    assert stats.top_keywords_exact(points, 1).collect() == [("gear", 1)]
    with pytest.raises(ValueError):
        stats.top_values(points, -1)


def test_collation_groups(spark):
    names = spark.createDataFrame([(str(i), n) for i, n in enumerate(["José", "jose", "JOSE ", "Bob"])], "source_id string, value string")
    assert stats.value_counts(names).count() == 4
    assert sorted(tuple(r) for r in stats.value_counts(names, COLLATION).collect()) == [("Bob", 1), ("JOSE ", 3)]
    assert stats.distinct_values(names, COLLATION).head()[0] == 2


@pytest.mark.parametrize("q, pattern", [("a", "%a%"), ("50%", "%50%%"), (r"50\%", r"%50\%%"), (r"a\b", "%ab%"), ("a\\", "%a\\%"), (r"a\\b", r"%a\\b%")])
def test_like_pattern(q, pattern):
    assert search.like_pattern(q) == pattern


def papers(spark):
    return spark.createDataFrame(
        [(1, 2020, "Alpha 50% off", ""), (2, 2021, "Été", "beta"), (3, 2021, "gamma", "ALPHA"), (4, 2019, "x", None)],
        "id bigint, year int, title string, abstract string")


def test_search(spark):
    def ids(**k):
        return [r["id"] for r in search.search_page(papers(spark), **k).collect()]
    assert ids() == [3, 2, 1, 4]
    assert ids(q="alpha") == [3, 1]
    assert ids(q="ete") == [] and ids(q="ete", fold_accents=True) == [2]
    assert ids(q="a%a") == [3, 1]
    assert ids(q=r"50\%") == [1]
    assert ids(year=2021, limit=1, offset=1) == [2]
    assert ids(limit=5, offset=9) == [] and ids(limit=0) == []
    assert [r["id"] for r in search.search_after(papers(spark), 2021, 3, limit=2).collect()] == [2, 1]
    for bad in ({"limit": -1}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.search_page(papers(spark), **bad)


def test_page_meta(spark):
    total = search.search_total(papers(spark))
    assert tuple(search.page_meta(total, 2, 2).head()) == (4, 2, 2, True, False, "3-4 / 4")
    assert tuple(search.page_meta(search.search_total(papers(spark), q="zzz"), 12, 0).head()) == (0, 12, 0, False, False, "0-0 / 0")


def test_request_int():
    assert [search.request_int(v, 20) for v in (None, "", "x", "7", "-3", "1.5")] == [20, 20, 20, 7, -3, 20]


def test_deep_pages_equal_near_ones(spark):
    rows = [(i * 7919 % 100_003, 2000 + i % 4 if i % 50 else None) for i in range(900)] + [(None, 2001)]
    df = spark.createDataFrame(rows, "id bigint, year int").withColumns({"title": F.lit("t"), "abstract": F.lit("a")})
    near = [tuple(r) for r in search.search_page(df, limit=901).collect()]
    for offset, limit in ((0, 5), (224, 3), (440, 30), (895, 20), (2000, 5)):
        deep = search.search_page(df, limit=limit, offset=offset, deep_page=0)
        assert [tuple(r) for r in deep.collect()] == near[offset:offset + limit]

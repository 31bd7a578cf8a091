"""Plan shape and skew: what must hold for the plans to scale."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import ingest as ops, records, search, stats
from quillstream.operators.perkey import first_n_per_group
from quillstream.plans import registry

FOLDER = "/root/testdata/sf0.001"
WRITES = {"ingest_atomic", "json_file_scan"}
LAZY = sorted(n for n in registry.QUERIES if not n.startswith("stream_") and n not in WRITES)
ENTITIES = {"clean_html", "detail_fields", "detail_nested", "listing_papers", "listing_authors", "listing_author_values", "resolve_links", "resolve_links_relative"}

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", LAZY)
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "collect_list" not in text and "collect_set" not in text
    assert ("ArrowEvalPython" in text) == (name in ENTITIES)
    assert "BatchEvalPython" not in text


@needs_data
def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "papers")
    rows = [(i, f"s{i}", 2000 + i % 5, f"title {i}", "text", i) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, source_id string, year int, title string, abstract string, seq bigint").write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(search.search_total(stored, year=2003))
    assert "EqualTo(year,2003)" in text and "ReadSchema: struct<year:int>" in text
    text = plan(search.search_after(stored.select("id", "year", "title"), 2003, 17))
    assert "LessThanOrEqual(year,2003)" in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<year:int>" in plan(stats.yearly_counts(stored))


def test_per_key_rules_combine_before_the_shuffle(stored):
    for df in (ops.first_events(stored), ops.latest_events(stored)):
        assert "partial_m" in plan(df) and "Window" not in plan(df)
    assert "WindowGroupLimit" in plan(first_n_per_group(stored, "year", ["id"], 5))


def test_keywords_need_no_shuffle(stored):
    from quillstream.functions.keywords import extract_keywords
    assert "Exchange" not in plan(stored.select(extract_keywords(F.col("title"))))


def test_first_n_of_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 3)}", rng.choice([i, -i, 10**12 + i]) if rng.random() < 0.98 else None, i)
            for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, pos bigint, tie bigint")
    for n in (3, 1500, 100_000):
        got = sorted(tuple(r) for r in first_n_per_group(df, "g", ["pos", "tie"], n).select("g", "tie").collect())
        want = []
        for g in {r[0] for r in rows}:
            ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            want += [(g, r[2]) for r in ordered[:n]]
        assert got == sorted(want)


def test_hot_url_neither_multiplies_nor_loses_rows(spark):
    listing = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("u"), "id")).alias("paper_url"),
        F.lit("t").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("pdf_url"), F.array(F.lit("k")).alias("keywords"))
    details = spark.range(2000).select(F.lit("hot").alias("paper_url"), F.lit("body text").alias("abstract"), F.lit("p").alias("pdf_url"))
    out = records.enrich_details(listing, details)
    assert out.count() == 3000
    assert out.where("abstract = 'body text'").count() == 1000


@needs_data
@pytest.mark.parametrize("name", ["listing_papers", "listing_authors", "listing_author_values", "detail_fields", "detail_nested"])
def test_a_task_has_one_python_worker(spark, name):
    assert plan(registry.QUERIES[name](spark, FOLDER)).count("ArrowEvalPython") == 1


@needs_data
def test_words_are_counted_without_a_shuffle_of_their_rows(spark, tmp_path):
    df = registry.QUERIES["top_words_exact"](spark, FOLDER)
    assert "array_distinct" in (text := plan(df)) and not any("source_id" in line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    # rows that share an id count once
    docs = [(1, "s", "alpha beta alpha"), (1, "s", "alpha gamma"), (2, "s", "beta"), (None, None, "delta"), (None, None, "delta")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.QUERIES["top_words_exact"](spark, str(tmp_path)).collect()}
    assert got == {("alpha", 1), ("beta", 2), ("gamma", 1), ("delta", 1)}

"""Counters, rankings, distinct counts and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstream import lexicon
from quillstream.functions.text import fold_key


def yearly_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("year").agg(F.count("*").alias("count"))


def value_counts(dimension: DataFrame, collation: str | None = None) -> DataFrame:
    """Records per value as ``(name, value)``; partial counts absorb hot values.

    Under a collation the spellings are counted first by plain equality, so the
    costly collated grouping sees one row per spelling. The smallest spelling
    names its group.
    """
    spellings = dimension.groupBy(F.col("value").alias("name")).agg(F.count("*").alias("value"))
    if not collation:
        return spellings
    return (
        spellings.groupBy(fold_key(F.col("name"), collation).alias("_key"))
        .agg(F.min("name").alias("name"), F.sum("value").alias("value"))
        .select("name", "value")
    )


def rebuild_counters(papers: DataFrame, dims: dict[str, DataFrame], collation: str | None = None) -> dict[str, DataFrame]:
    """The four counters recomputed from the detail tables."""
    tables = {"yearly": papers.groupBy("year").agg(F.count("*").alias("paper_count"))}
    for name, dimension in dims.items():
        counts = value_counts(dimension, collation)
        tables[name] = counts.select(F.col("name").alias("value"), F.col("value").alias("paper_count"))
    return tables


def rebuild_ledger(papers: DataFrame) -> DataFrame:
    return papers.select("source_id").distinct()


def with_fallback(stored: DataFrame, detail: DataFrame, probe: bool = False) -> DataFrame:
    """Stored rows, or the detail aggregate when there are none.

    The default is one lazy plan: an uncorrelated EXISTS over ``stored`` gates
    the detail branch. ``probe=True`` is for stored tables: it reads at most one
    row now, so the large detail branch is not planned at all.
    """
    if probe:
        return detail if stored.isEmpty() else stored
    return stored.unionByName(detail.where(~stored.exists()))


def not_stopword(c: Column, stopwords: list[str] | None = None) -> Column:
    return ~F.lower(c).isin(lexicon.STOPWORDS if stopwords is None else stopwords)


def top_values(points: DataFrame, limit: int = lexicon.RANKING_LIMIT) -> DataFrame:
    """Highest count first, ties by name; planned as a distributed top-k."""
    _check_limit(limit)
    return points.orderBy(F.desc("value"), "name").limit(limit)


def top_keywords(points: DataFrame, limit: int = lexicon.KEYWORD_LIMIT) -> DataFrame:
    """Top ``limit`` among the leading ``5 * limit`` rows that are no stopwords.

    Over-fetching can give fewer than ``limit`` rows; see ``top_keywords_exact``.
    """
    leading = top_values(points, max(limit * lexicon.OVERFETCH, limit))
    return top_values(leading.where(not_stopword(F.col("name"))), limit)


def top_keywords_exact(points: DataFrame, limit: int = lexicon.KEYWORD_LIMIT) -> DataFrame:
    return top_values(points.where(not_stopword(F.col("name"))), limit)


def ranked_values(stored: DataFrame, dimension: DataFrame, limit: int = lexicon.RANKING_LIMIT,
                  collation: str | None = None, probe: bool = False) -> DataFrame:
    """Stored ranking, or one computed from the dimension when the store is empty."""
    return top_values(with_fallback(stored, value_counts(dimension, collation), probe), limit)


def ranked_keywords(stored: DataFrame, dimension: DataFrame, limit: int = lexicon.KEYWORD_LIMIT,
                    collation: str | None = None, probe: bool = False) -> DataFrame:
    """As ``ranked_values``; emptiness is judged after the stopwords are gone."""
    kept = top_keywords(stored, limit)
    return top_values(with_fallback(kept, top_keywords(value_counts(dimension, collation), limit), probe), limit)


def display_order(ranking: DataFrame) -> DataFrame:
    """A descending top-k turned over for a bar chart."""
    return ranking.orderBy("value", F.desc("name"))


def years(papers: DataFrame) -> DataFrame:
    return papers.select("year").distinct().orderBy(F.desc("year"))


def distinct_values(dimension: DataFrame, collation: str | None = None, approximate: bool = False) -> DataFrame:
    if approximate:
        return dimension.agg(F.approx_count_distinct(fold_key(F.col("value"), collation)).alias("n"))
    if not collation:
        return dimension.agg(F.count_distinct("value").alias("n"))
    spellings = dimension.select("value").where(F.col("value").isNotNull()).distinct()
    return spellings.agg(F.count_distinct(fold_key(F.col("value"), collation)).alias("n"))


def summary(papers: DataFrame, keywords: DataFrame, authors: DataFrame, institutions: DataFrame,
            collation: str | None = None, approximate: bool = False) -> DataFrame:
    """Five totals in one row: scalar subqueries, so no join of any kind."""
    wanted = keywords.where(not_stopword(F.col("value")))
    years_count = F.approx_count_distinct("year") if approximate else F.count_distinct("year")
    counts = {
        "papers": papers.agg(F.count("*").alias("n")),
        "years": papers.agg(years_count.alias("n")),
        "keywords": distinct_values(wanted, collation, approximate),
        "authors": distinct_values(authors, collation, approximate),
        "institutions": distinct_values(institutions, collation, approximate),
    }
    one_row = papers.sparkSession.range(1)
    return one_row.select(*[frame.scalar().alias(name) for name, frame in counts.items()])


def dashboard_kpis(yearly: DataFrame, totals: DataFrame) -> DataFrame:
    """Headline figures; the trend stands in where the summary shows zero."""
    trend = yearly.agg(F.sum("count").alias("total"), F.min("year").alias("low"), F.max("year").alias("high"))
    span = F.when(F.col("low").isNull(), F.lit("0")).otherwise(F.concat_ws("-", "low", "high"))
    entities = F.col("keywords") + F.col("authors") + F.col("institutions")
    total = F.coalesce(F.col("total"), F.lit(0))
    return trend.select(
        F.coalesce(_nonzero(totals.select("papers").scalar()), total).cast("bigint").alias("total_papers"),
        F.coalesce(_nonzero(totals.select("years").scalar()).cast("string"), span).alias("years_text"),
        span.alias("year_span"),
        totals.select(entities).scalar().alias("entity_count"),
    )


def _nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def _check_limit(limit: int) -> None:
    if limit < 0:
        raise ValueError("limit must not be negative")

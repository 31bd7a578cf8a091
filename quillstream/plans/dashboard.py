"""The reads a dashboard makes together, as lazy frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstream import lexicon
from quillstream.operators import search, stats
from quillstream.operators.ingest import YEARLY
from quillstream.schemas import LIST_FIELDS
from quillstream.streaming.tables import BatchTables


def dashboard(tables: dict[str, DataFrame], q: str = "", year: int = 0, limit: int = lexicon.DASHBOARD_SEARCH_LIMIT,
              offset: int = 0, collation: str | None = None, probe: bool = True) -> dict[str, DataFrame]:
    """Seven reads over ``papers``, ``authors``, ``institutions``, ``keywords`` and
    the counters ``stats_yearly`` (year, count), ``stats_<dimension>`` (name, value).

    ``probe`` reads one row of each counter now, so that detail tables are left out
    of the plans while counters hold rows; without it all frames are lazy.
    """
    papers = tables["papers"]
    yearly = stats.with_fallback(tables["stats_yearly"], stats.yearly_counts(papers), probe).orderBy("year")
    totals = stats.summary(papers, tables["keywords"], tables["authors"], tables["institutions"], collation)
    found = search.search(papers, q, year, limit, offset)
    ranking = lexicon.DASHBOARD_RANKING_LIMIT
    return {
        "papers": found["items"],
        "papers_meta": found["meta"],
        "summary": totals,
        "years": stats.years(papers),
        "yearly": yearly,
        "keywords": stats.ranked_keywords(tables["stats_keywords"], tables["keywords"], collation=collation, probe=probe),
        "authors": stats.ranked_values(tables["stats_authors"], tables["authors"], ranking, collation, probe),
        "institutions": stats.ranked_values(tables["stats_institutions"], tables["institutions"], ranking, collation, probe),
        "figures": stats.dashboard_kpis(yearly, totals),
    }


def stored_tables(tables: BatchTables) -> dict[str, DataFrame]:
    """The ingest tables under the names ``dashboard`` reads."""
    frames = {"papers": tables.papers()}
    yearly = tables.counter(YEARLY)
    frames["stats_yearly"] = yearly.select(F.col("value").cast("int").alias("year"), F.col("paper_count").alias("count"))
    for name in LIST_FIELDS:
        frames[name] = tables.dimension(name)
        frames[f"stats_{name}"] = tables.counter(name).select(F.col("value").alias("name"), F.col("paper_count").alias("value"))
    return frames

"""Rankings, totals, counters and searches over the catalog and text views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillstream import lexicon
from quillstream.functions.keywords import extract_keywords
from quillstream.functions.text import text_or_empty
from quillstream.operators import search, stats
from quillstream.plans.adapters import CATALOG_SQL, EVENTS_SQL, TEXT_SQL, Catalog, event_rows, papers_text, papers_text_spread, with_sql
from quillstream.plans.keyword_sql import KEYWORDS_SQL, STOP_LIST
from quillstream.operators.ingest import first_events
from quillstream.session import pin_session
from quillstream.sources.files import read_table

DIMS = {"author": "authors", "institution": "institutions", "keyword": "keywords"}


def keyword_dimension(spark, folder):
    papers = papers_text_spread(spark, folder)
    text = F.concat_ws(" ", "title", "abstract")
    return papers.select("source_id", F.explode(extract_keywords(text)).alias("value"))


def _count_by(name):
    return lambda spark, folder: stats.value_counts(getattr(Catalog(spark, folder), DIMS[name])())


def _top(name, limit):
    return lambda spark, folder: stats.top_values(stats.value_counts(getattr(Catalog(spark, folder), name)()), limit)


def _rebuild(name):
    def run(spark, folder):
        c = Catalog(spark, folder)
        dims = {} if name == "yearly" else {name: getattr(c, name)()}
        return stats.rebuild_counters(c.records(), dims)[name]
    return run


def _summary(spark, folder):
    c = Catalog(spark, folder)
    return stats.summary(c.records(), c.keywords(), c.authors(), c.institutions())


def _kpis(spark, folder):
    c = Catalog(spark, folder)
    return stats.dashboard_kpis(stats.yearly_counts(c.records()), _summary(spark, folder))


def _yearly_fallback(spark, folder):
    papers = Catalog(spark, folder).records()
    empty = stats.yearly_counts(papers).where(F.col("year") < 0)
    return stats.with_fallback(empty, stats.yearly_counts(papers)).orderBy("year")


def _yearly_stored(spark, folder):
    events = event_rows(read_table(pin_session(spark), folder, "events"))
    stored = stats.yearly_counts(first_events(events.select("source_id", "seq", "year")))
    return stats.with_fallback(stored, stats.yearly_counts(Catalog(spark, folder).records()), probe=True).orderBy("year")


def _top_keywords(spark, folder):
    return stats.top_keywords(stats.value_counts(keyword_dimension(spark, folder)))


def _top_words(top):
    """Rankings over every word of a text, stopwords among the leaders."""
    def run(spark, folder):
        papers = papers_text_spread(spark, folder)
        # repeats within a text go before its words become rows; only rows that share an id need more
        words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("abstract"), F.lit("[a-z]+"), F.lit(0))))
        counts = papers.select("source_id", words.alias("value"))
        repeated = papers_text(spark, folder).groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
        return top(stats.value_counts(counts if repeated.isEmpty() else counts.distinct()), 10)
    return run


def _found(q="", year=0, **options):
    return lambda spark, folder: papers_text(spark, folder).where(search.matches(q, year, **options))


def _page(q="", year=0, limit=20, offset=0):
    return lambda spark, folder: search.search_page(papers_text(spark, folder), q, year, limit, offset)


def _search_walk(deep_page):
    """All pages over ids of which each stands for more rows than a page holds; the second by offset, the others by key."""
    def run(spark, folder):
        papers = papers_text(spark, folder).withColumn("id", F.col("id") % 3).select("id", "source_id", "year", "title", "abstract")
        limit = -(-search.search_total(papers).head()["total"] // 9)
        if not limit:
            return papers.select(F.lit(0).alias("page"), "id", "source_id", "year")
        seen = lambda page: page.select("id", "source_id", "year").persist()
        pages = [seen(search.search_page(papers, limit=limit, offset=k * limit, deep_page=deep_page)) for k in (0, 1)]
        while last := pages[-1].orderBy("year", "id", "source_id").head():
            pages.append(seen(search.search_after(papers, last["year"], last["id"], limit=limit, after_key=last["source_id"], deep_page=deep_page)))
        parts = [p.select(F.lit(k).alias("page"), "id", "source_id", "year") for k, p in enumerate(pages)]
        return reduce(DataFrame.unionByName, parts)
    return run


_COLLATED = "UNICODE_CI_AI_RTRIM"


def _count_collated(spark, folder):
    """Word counts that ignore case, accents and trailing blanks."""
    papers = papers_text_spread(spark, folder)
    words = F.explode(F.split(F.regexp_replace("abstract", "[^A-Za-zÀ-ÿ]+", " "), " "))
    rows = papers.select("source_id", words.alias("value")).where(F.col("value") != "")
    return stats.value_counts(rows, _COLLATED)


QUERIES = {
    "yearly": lambda s, d: stats.yearly_counts(Catalog(s, d).records()).orderBy("year"),
    "years": lambda s, d: stats.years(Catalog(s, d).records()),
    "count_by_author": _count_by("author"),
    "count_by_institution": _count_by("institution"),
    "count_by_keyword": _count_by("keyword"),
    "count_by_value_collated": _count_collated,
    "top_authors": _top("authors", lexicon.RANKING_LIMIT),
    "top_institutions": _top("institutions", lexicon.RANKING_LIMIT),
    "top_authors_display": lambda s, d: stats.display_order(_top("authors", lexicon.DASHBOARD_RANKING_LIMIT)(s, d)),
    "top_keywords": _top_keywords,
    "top_words_overfetch": _top_words(stats.top_keywords),
    "top_words_exact": _top_words(stats.top_keywords_exact),
    "keyword_distinct": lambda s, d: stats.distinct_values(keyword_dimension(s, d).where(stats.not_stopword(F.col("value")))),
    "summary": _summary,
    "dashboard_kpis": _kpis,
    "yearly_fallback": _yearly_fallback,
    "yearly_stored": _yearly_stored,
    "rebuild_yearly": _rebuild("yearly"),
    "rebuild_authors": _rebuild("authors"),
    "rebuild_institutions": _rebuild("institutions"),
    "rebuild_keywords": _rebuild("keywords"),
    "rebuild_ledger": lambda s, d: stats.rebuild_ledger(Catalog(s, d).records()),
    "dim_authors": lambda s, d: Catalog(s, d).authors(),
    "dim_institutions": lambda s, d: Catalog(s, d).institutions(),
    "dim_keywords": lambda s, d: keyword_dimension(s, d),
    "search_all": _page(limit=20),
    "search_text": _found("the and"),
    "search_text_wildcard": _found("th_t%is"),
    "search_text_accents": lambda s, d: _found("ETRE", fold_accents=True)(s, d).select("id", "source_id", "year"),
    "search_text_accents_wildcard": lambda s, d: _found("Ètr_%pä%VI", fold_accents=True)(s, d).select("id", "source_id", "year"),
    "search_year": _found(year=2022),
    "search_q_year": _page("THE", 2021, 12, 0),
    "search_page": _page("la", 0, 12, 24),
    "search_deep_page": lambda s, d: search.search_page(papers_text(s, d), "la", 0, 15, 90, deep_page=50),
    "search_past_end": _page("la", 2023, 20, 10_000_000),
    "search_after": lambda s, d: search.search_after(papers_text(s, d), 2024, 400, "la", limit=12),
    "search_walk": _search_walk(search.DEEP_PAGE),
    "search_walk_deep": _search_walk(0),
    "search_total": lambda s, d: search.search_total(papers_text(s, d), "the", 2024),
    "page_meta": lambda s, d: search.page_meta(search.search_total(papers_text(s, d), "de", 2022), 12, 12),
}

_C = CATALOG_SQL
_KW = with_sql(TEXT_SQL, KEYWORDS_SQL.format(source="papers_t", key="source_id", text="concat(title, ' ', abstract)"))
_SUMMARY = f"""SELECT (SELECT count(*) FROM papers_c) AS papers, (SELECT count(DISTINCT year) FROM papers_c) AS years,
    (SELECT count(DISTINCT value) FROM keywords_c WHERE lower(value) NOT IN ({STOP_LIST})) AS keywords,
    (SELECT count(DISTINCT value) FROM authors_c) AS authors,
    (SELECT count(DISTINCT value) FROM institutions_c) AS institutions"""
_ALL_C = with_sql(*_C.values())


def _count_sql(dim):
    return with_sql(_C[dim]) + f"SELECT value AS name, count(*) AS value FROM {dim} GROUP BY 1"


def _counter_sql(dim):
    return with_sql(_C[dim]) + f"SELECT value, count(*) AS paper_count FROM {dim} GROUP BY 1"


def _top_sql(dim, limit):
    return with_sql(_C[dim]) + f"SELECT value AS name, count(*) AS value FROM {dim} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"


_WORDS = with_sql(TEXT_SQL, """words AS (SELECT value AS name, count(DISTINCT source_id) AS value FROM (
    SELECT source_id, unnest(regexp_extract_all(lower(abstract), '[a-z]+')) AS value FROM papers_t) GROUP BY 1)""")
_T = with_sql(TEXT_SQL)
_WALK = _T + """SELECT CAST(floor((row_number() OVER (ORDER BY year DESC, id % 3 DESC, source_id DESC) - 1) / ceil((SELECT count(*) FROM papers_t) / 9.0)) AS INT) AS page,
    id % 3 AS id, source_id, year FROM papers_t"""

ORACLE = {
    "yearly": with_sql(_C["papers_c"]) + "SELECT year, count(*) AS count FROM papers_c GROUP BY 1 ORDER BY 1",
    "years": with_sql(_C["papers_c"]) + "SELECT DISTINCT year FROM papers_c ORDER BY 1 DESC",
    "count_by_author": _count_sql("authors_c"),
    "count_by_institution": _count_sql("institutions_c"),
    "count_by_keyword": _count_sql("keywords_c"),
    "count_by_value_collated": _T + """SELECT min(w) AS name, count(*) AS value FROM (
        SELECT unnest(regexp_extract_all(abstract, '[A-Za-zÀ-ÿ]+')) AS w FROM papers_t)
        GROUP BY replace(strip_accents(lower(w)), 'ß', 'ss')""",
    "top_authors": _top_sql("authors_c", lexicon.RANKING_LIMIT),
    "top_institutions": _top_sql("institutions_c", lexicon.RANKING_LIMIT),
    "top_authors_display": f"SELECT * FROM ({_top_sql('authors_c', lexicon.DASHBOARD_RANKING_LIMIT)}) ORDER BY value, name DESC",
    "top_keywords": _KW + f"""SELECT * FROM (SELECT term AS name, count(*) AS value FROM keyword_rows GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT {lexicon.KEYWORD_LIMIT * lexicon.OVERFETCH}) WHERE lower(name) NOT IN ({STOP_LIST})
        ORDER BY 2 DESC, 1 LIMIT {lexicon.KEYWORD_LIMIT}""",
    "top_words_overfetch": _WORDS + f"""SELECT * FROM (SELECT * FROM words ORDER BY value DESC, name LIMIT 50)
        WHERE name NOT IN ({STOP_LIST}) ORDER BY value DESC, name LIMIT 10""",
    "top_words_exact": _WORDS + f"SELECT * FROM words WHERE name NOT IN ({STOP_LIST}) ORDER BY value DESC, name LIMIT 10",
    "keyword_distinct": _KW + f"SELECT count(DISTINCT term) AS n FROM keyword_rows WHERE lower(term) NOT IN ({STOP_LIST})",
    "summary": _ALL_C + _SUMMARY,
    "dashboard_kpis": _ALL_C + f""", s AS ({_SUMMARY}), y AS (SELECT year, count(*) AS count FROM papers_c GROUP BY 1)
        SELECT CAST(coalesce(nullif((SELECT papers FROM s), 0), sum(count)) AS BIGINT) AS total_papers,
        coalesce(CAST(nullif((SELECT years FROM s), 0) AS VARCHAR), concat(min(year), '-', max(year))) AS years_text,
        concat(min(year), '-', max(year)) AS year_span,
        (SELECT keywords + authors + institutions FROM s) AS entity_count FROM y""",
    "yearly_fallback": with_sql(_C["papers_c"]) + "SELECT year, count(*) AS count FROM papers_c GROUP BY 1 ORDER BY 1",
    "yearly_stored": with_sql(EVENTS_SQL) + """SELECT year, count(*) AS count FROM (SELECT source_id, arg_min(year, seq) AS year
        FROM ev GROUP BY 1) GROUP BY 1 ORDER BY 1""",
    "rebuild_yearly": with_sql(_C["papers_c"]) + "SELECT year, count(*) AS paper_count FROM papers_c GROUP BY 1",
    "rebuild_authors": _counter_sql("authors_c"),
    "rebuild_institutions": _counter_sql("institutions_c"),
    "rebuild_keywords": _counter_sql("keywords_c"),
    "rebuild_ledger": with_sql(_C["papers_c"]) + "SELECT DISTINCT source_id FROM papers_c",
    "dim_authors": with_sql(_C["authors_c"]) + "SELECT source_id, value FROM authors_c",
    "dim_institutions": with_sql(_C["institutions_c"]) + "SELECT source_id, value FROM institutions_c",
    "dim_keywords": _KW + "SELECT source_id, term AS value FROM keyword_rows",
    "search_all": _T + "SELECT * FROM papers_t ORDER BY year DESC, id DESC LIMIT 20",
    "search_text": _T + "SELECT * FROM papers_t WHERE title ILIKE '%the and%' OR abstract ILIKE '%the and%'",
    "search_text_wildcard": _T + "SELECT * FROM papers_t WHERE title ILIKE '%th_t%is%' OR abstract ILIKE '%th_t%is%'",
    "search_text_accents_wildcard": _T + " SELECT id, source_id, year FROM papers_t WHERE " + " OR ".join(
        f"replace(strip_accents(lower({c})), 'ß', 'ss') LIKE '%{q}%'" for c in ("title", "abstract") for q in ["etr_%pa%vi"]),
    "search_text_accents": _T + """SELECT id, source_id, year FROM papers_t
        WHERE contains(strip_accents(lower(title)), 'etre') OR contains(strip_accents(lower(abstract)), 'etre')""",
    "search_year": _T + "SELECT * FROM papers_t WHERE year = 2022",
    "search_q_year": _T + """SELECT * FROM papers_t WHERE (title ILIKE '%THE%' OR abstract ILIKE '%THE%') AND year = 2021
        ORDER BY year DESC, id DESC LIMIT 12""",
    "search_page": _T + """SELECT * FROM papers_t WHERE title ILIKE '%la%' OR abstract ILIKE '%la%'
        ORDER BY year DESC, id DESC LIMIT 12 OFFSET 24""",
    "search_deep_page": _T + """SELECT * FROM papers_t WHERE title ILIKE '%la%' OR abstract ILIKE '%la%'
        ORDER BY year DESC, id DESC LIMIT 15 OFFSET 90""",
    "search_past_end": _T + """SELECT * FROM papers_t WHERE (title ILIKE '%la%' OR abstract ILIKE '%la%') AND year = 2023
        ORDER BY year DESC, id DESC LIMIT 20 OFFSET 10000000""",
    "search_after": _T + """SELECT * FROM papers_t WHERE (title ILIKE '%la%' OR abstract ILIKE '%la%')
        AND (year < 2024 OR (year = 2024 AND id < 400)) ORDER BY year DESC, id DESC LIMIT 12""",
    "search_walk": _WALK,
    "search_walk_deep": _WALK,
    "search_total": _T + """SELECT count(*) AS total FROM papers_t WHERE (title ILIKE '%the%' OR abstract ILIKE '%the%')
        AND year = 2024""",
    "page_meta": _T + """SELECT total, CAST(12 AS BIGINT) AS "limit", CAST(12 AS BIGINT) AS "offset", true AS has_prev,
        24 < total AS has_next, concat(CASE WHEN total = 0 THEN 0 ELSE 13 END, '-', least(24, total), ' / ', total) AS range_text
        FROM (SELECT count(*) AS total FROM papers_t WHERE (title ILIKE '%de%' OR abstract ILIKE '%de%') AND year = 2022)""",
}

"""Stored pages to records, links and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions import markup
from quillstream.operators import pages as ops
from quillstream.operators.perkey import first_n_per_group
from quillstream.operators.records import crawl_order, enrich_details, limit_per_year
from quillstream.plans.adapters import CATALOG_SQL, Catalog, with_sql
from quillstream.plans.keyword_sql import KEYWORDS_SQL, WIDE_SPACE
from quillstream.session import pin_session, spread
from quillstream.sources.files import read_pages

# The stored pages list their entries as <li><a ..>, with the text in <article>.
LAYOUT = ops.ListingLayout(start=r"(?is)<li>")
DETAIL = ops.DetailLayout(abstract=r"(?is)<(article)\b[^>]*>")
PER_YEAR = 7


def stored_pages(spark, folder):
    return read_pages(pin_session(spark), f"{folder}/pages.parquet")


def _spread_pages(spark, folder):
    return spread(stored_pages(spark, folder), "page_id")


def _clean(make):
    return lambda spark, folder: _spread_pages(spark, folder).select("page_id", make(F.col("html")).alias("clean"))


def listing(spark, folder):
    pages = _spread_pages(spark, folder).withColumn("year", (F.lit(2018) + F.col("page_id") % 5).cast("int"))
    return ops.listing_papers(pages, LAYOUT)


def _listing(spark, folder):
    rows = listing(spark, folder)
    return rows.select("page_id", "year", "pos", "title", F.concat_ws("|", "authors").alias("authors"), "paper_url", "pdf_url")


def _blocks(spark, folder):
    rows = ops.listing_blocks(_spread_pages(spark, folder), LAYOUT)
    return rows.select("page_id", "url", "pos", "block", "next_block")


def _links_resolved(spark, folder):
    rows = ops.link_rows(_spread_pages(spark, folder), keep=("page_id", "url"))
    return rows.select("page_id", "pos", markup.resolve_url(F.col("url"), F.col("href")).alias("link"))


def _links_relative(spark, folder):
    """Every href of a page as a relative, scheme-relative, dotted or absolute reference, by position, against the page's own url."""
    pages = _spread_pages(spark, folder)
    rows = pages.select("page_id", "url", F.posexplode(markup.page_links(F.col("html"))).alias("pos", "href"))
    tail = F.substr("href", F.lit(2))
    kind = F.col("pos") % 4
    ref = (F.when(kind == 0, F.concat(F.lit("../x/./"), tail))
           .when(kind == 1, F.concat(F.lit("//other.example.org"), F.col("href")))
           .when(kind == 2, F.concat(F.lit("https://abs.example.org/"), tail))
           .otherwise(tail))
    return rows.select("page_id", "pos", markup.resolve_url(F.col("url"), ref).alias("link"))


def _listing_rules(**rules):
    """Anchors as authors, and as pdf links where a word begins with a t: pages that have both."""
    def run(spark, folder):
        pages = _spread_pages(spark, folder).withColumn("html", F.regexp_replace("html", r'<a href="/(t[^"]*)">', r'<a href="/$1.pdf">'))
        rows = ops.listing_papers(pages, ops.ListingLayout(start=LAYOUT.start, **rules))
        return rows.select("page_id", "pos", "title", F.concat_ws("|", "authors").alias("authors"), "paper_url", "pdf_url")
    return run


def _details_nested(spark, folder):
    """Articles wrapped twice more in elements of their own name come out whole."""
    wrap = F.regexp_replace(F.regexp_replace("html", "<article>", '<article id="abstract">Abstract <article><article>'), "</article>", "</article></article> end</article>")
    return ops.detail_fields(_spread_pages(spark, folder).withColumn("html", wrap))


def _details(spark, folder):
    return ops.detail_fields(_spread_pages(spark, folder), DETAIL)


def _enriched(spark, folder):
    """Page headings as records, enriched from the same pages' articles; every
    third detail page is missing and every fifth record has no url."""
    pages = _spread_pages(spark, folder)
    title = markup.strip_tags(F.regexp_extract("html", "(?is)<h1>(.*?)</h1>", 1))
    records = pages.select(
        "page_id", title.alias("title"), F.lit("none").alias("abstract"),
        F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("paper_url"),
        F.when(F.col("page_id") % 2 == 0, "given.pdf").otherwise("").alias("pdf_url"),
        F.array(F.lit("old")).alias("keywords"),
    )
    article = F.regexp_extract("html", "(?is)<article>(.*?)</article>", 1)
    details = pages.where(F.col("page_id") % 3 != 0).select(
        F.col("url").alias("paper_url"), markup.strip_tags(article).alias("abstract"), F.lit("found.pdf").alias("pdf_url"))
    out = enrich_details(records, details)
    return out.withColumn("keywords", F.concat_ws("|", "keywords"))


def _crawl_order(spark, folder):
    papers = Catalog(spark, folder).papers().select("id", "year", "title")
    batches = [papers.where(F.col("year") <= 1997), papers.where(F.col("year") == 1998), papers.where(F.col("year") > 1998)]
    return crawl_order(batches, "id")


QUERIES = {
    "pages_scan": lambda s, d: stored_pages(s, d).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars")),
    "strip_tags": _clean(markup.strip_tags),
    "clean_html": _clean(markup.clean_html),
    "page_links": lambda s, d: ops.link_rows(_spread_pages(s, d)),
    "resolve_links": _links_resolved,
    "resolve_links_relative": _links_relative,
    "listing_blocks": _blocks,
    "listing_papers": _listing,
    "listing_authors": _listing_rules(authors=r"(?is)>([^<]*)</a>"),
    "listing_author_values": _listing_rules(authors=r'(?is)href="/([^".]*)', author_rule="values", pdf_rule="suffix"),
    "detail_fields": _details,
    "detail_nested": _details_nested,
    "enrich_details": _enriched,
    "limit_per_year": lambda s, d: limit_per_year(Catalog(s, d).papers().select("id", "year", "title"), PER_YEAR, ["id"]),
    "limit_per_year_large": lambda s, d: first_n_per_group(Catalog(s, d).papers().select("id", "year", "title"), "year", ["id"], 1500),
    "crawl_order": _crawl_order,
}


def _strip(expr):
    return f"trim(regexp_replace(regexp_replace({expr}, '<[^>]+>', ' ', 'g'), '[{WIDE_SPACE}]+', ' ', 'g'))"


def _unescape(expr):
    for entity, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        expr = f"regexp_replace({expr}, '{entity}', '{char}', 'g')"
    return expr


def _clean_sql(expr):
    untagged = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({_unescape(untagged)}, '[{WIDE_SPACE}]+', ' ', 'g'))"


_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
_HREFS = """regexp_extract_all(html, '(?is)<a[^>]*href=["'']([^"'']+)', 1)"""
_LINKS = f"""links AS (SELECT page_id, url, CAST(unnest(range(len(h))) AS INT) AS pos, unnest(h) AS href FROM
    (SELECT page_id, url, {_HREFS} AS h FROM pages))"""
# Splitting at every <li> leaves the lead-in first and each block without its mark.
_PARTS = """parts AS (SELECT page_id, url, CAST(pos - 1 AS INT) AS pos, concat('<li>', part) AS block FROM
    (SELECT page_id, url, unnest(p) AS part, unnest(range(len(p))) AS pos FROM
        (SELECT page_id, url, string_split(html, '<li>') AS p FROM pages)) WHERE pos > 0)"""

_PDF_PARTS = """parts AS (SELECT page_id, url, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS body, unnest(h) AS href FROM
    (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS a,
        list_transform(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1), lambda x: CASE WHEN x LIKE '/t%' THEN x || '.pdf' ELSE x END) AS h FROM pages))"""

ORACLE = {
    "pages_scan": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "strip_tags": f"SELECT page_id, {_strip('html')} AS clean FROM pages",
    "clean_html": f"SELECT page_id, {_clean_sql('html')} AS clean FROM pages",
    "page_links": with_sql(_LINKS) + "SELECT page_id, pos, href FROM links",
    "resolve_links": with_sql(_LINKS) + f"SELECT page_id, pos, concat({_ORIGIN}, href) AS link FROM links",
    "resolve_links_relative": with_sql(_LINKS) + f"""SELECT page_id, pos, CASE pos % 4
        WHEN 0 THEN concat({_ORIGIN}, regexp_extract(url, '^https?://[^/?#]+(/.*?)?[^/?#]*/[^/?#]*([?#].*)?$', 1), 'x/', substring(href, 2)) WHEN 1 THEN concat(regexp_extract(url, '^https?:'), '//other.example.org', href)
        WHEN 2 THEN concat('https://abs.example.org/', substring(href, 2))
        ELSE concat(regexp_extract(url, '^https?://[^/?#]+/([^?#]*/)?'), substring(href, 2)) END AS link FROM links""",
    "listing_blocks": with_sql(_PARTS) + """SELECT page_id, url, pos, block,
        lead(block) OVER (PARTITION BY page_id ORDER BY pos) AS next_block FROM parts""",
    "listing_papers": with_sql(_PARTS) + f"""SELECT page_id, CAST(2018 + page_id % 5 AS INT) AS year, pos,
        {_clean_sql("regexp_extract(block, '<a href=\"([^\"]*)\">(.*?)</a>', 2)")} AS title, '' AS authors,
        concat({_ORIGIN}, {_unescape("regexp_extract(block, '<a href=\"([^\"]*)\">(.*?)</a>', 1)")}) AS paper_url, '' AS pdf_url
        FROM parts""",
    "listing_authors": with_sql(_PDF_PARTS) + f"""SELECT page_id, pos, {_clean_sql("body")} AS title,
        trim({_clean_sql("body")}, ', ') AS authors, concat({_ORIGIN}, href) AS paper_url,
        CASE WHEN href LIKE '%.pdf' THEN concat({_ORIGIN}, href)
             WHEN lead(href) OVER (PARTITION BY page_id ORDER BY pos) LIKE '%.pdf' THEN concat({_ORIGIN}, lead(href) OVER (PARTITION BY page_id ORDER BY pos))
             ELSE '' END AS pdf_url FROM parts""",
    "listing_author_values": with_sql(_PDF_PARTS) + f"""SELECT page_id, pos, {_clean_sql("body")} AS title,
        regexp_extract(href, '^/([^.]*)', 1) AS authors, concat({_ORIGIN}, href) AS paper_url,
        CASE WHEN href LIKE '%.pdf' THEN concat({_ORIGIN}, href) ELSE '' END AS pdf_url FROM parts""",
    "detail_nested": f"""SELECT page_id, url AS paper_url, trim(concat({_clean_sql("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, ' end')) AS abstract,
        '' AS pdf_url FROM pages""",
    "detail_fields": f"""SELECT page_id, url AS paper_url,
        {_clean_sql("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS abstract, '' AS pdf_url FROM pages""",
    "enrich_details": f"""WITH base AS (SELECT page_id, url, {_strip("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
        {_strip("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS article,
        page_id % 3 <> 0 AND page_id % 5 <> 0 AS found FROM pages), """
        + KEYWORDS_SQL.format(source="base", key="page_id", text="concat(title, ' ', article)")
        + """, kw AS (SELECT source_id AS page_id, string_agg(term, '|' ORDER BY rank) AS k FROM keyword_rows GROUP BY 1)
        SELECT page_id, title, CASE WHEN found THEN article ELSE 'none' END AS abstract,
        CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS paper_url,
        CASE WHEN page_id % 2 = 0 THEN 'given.pdf' WHEN found THEN 'found.pdf' ELSE '' END AS pdf_url,
        CASE WHEN found THEN coalesce(k, '') ELSE 'old' END AS keywords FROM base LEFT JOIN kw USING (page_id)""",
    "limit_per_year": with_sql(CATALOG_SQL["papers_c"]) + f"""SELECT id, year, title FROM (SELECT *,
        row_number() OVER (PARTITION BY year ORDER BY id) AS r FROM papers_c) WHERE r <= {PER_YEAR}""",
    "limit_per_year_large": with_sql(CATALOG_SQL["papers_c"]) + """SELECT id, year, title FROM (SELECT *,
        row_number() OVER (PARTITION BY year ORDER BY id) AS r FROM papers_c) WHERE r <= 1500""",
    "crawl_order": with_sql(CATALOG_SQL["papers_c"]) + "SELECT id, year, title FROM papers_c ORDER BY year DESC, title, id",
}

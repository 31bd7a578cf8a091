"""Stored pages to records: listing blocks, detail fields, links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillstream import lexicon
from quillstream.functions.arrays import bind
from quillstream.functions.markup import anchors, clean_html, element_body, page_links, resolve_url, unescape
from quillstream.functions.text import normalize_text_u, parse_authors, unique_clean


@dataclass(frozen=True)
class ListingLayout:
    """Where a listing keeps its parts. The defaults fit definition-list listings."""

    start: str = lexicon.LISTING_START
    authors: str = lexicon.NEXT_DD
    # "text": the first match, split on commas; "values": every match is one author.
    author_rule: str = "text"
    # "nearby": one of the next anchors by suffix or text; "suffix": first .pdf href of the block.
    pdf_rule: str = "nearby"


@dataclass(frozen=True)
class DetailLayout:
    """Where a detail page keeps the abstract.

    With ``group`` 0 ``abstract`` matches the element's opening tag, group 1 being
    its name, and the whole element is taken, nested ones included; otherwise that
    group is the body, as with ``lexicon.ABSTRACT_ELEMENT`` and 2, which ends at the
    first closing tag.
    """

    abstract: str = lexicon.ABSTRACT_OPEN
    group: int = 0
    any_case_label: bool = True
    pdf_rule: str = "nearby"


def split_blocks(html: Column, start: str) -> Column:
    """Pieces of a page, each beginning at a match of ``start``; the lead-in is dropped."""
    flags, body = ("", start)
    if start.startswith("(?"):
        flags, body = start.split(")", 1)[0] + ")", start.split(")", 1)[1]
    pieces = F.split(html, f"{flags}(?={body})", -1)
    return F.filter(pieces, lambda p: p.rlike(f"{flags}\\A{body}"))


def _anchored_blocks(pages: DataFrame, layout: ListingLayout) -> DataFrame:
    """One row per listing block: its text, its anchors, and the first anchor of the block after it."""
    keep = [c for c in pages.columns if c != "html"]
    parts = F.transform(split_blocks(F.col("html"), layout.start), lambda b: F.struct(b.alias("block"), anchors(b).alias("anchors")))
    numbered = bind(parts, lambda ps: F.transform(ps, lambda p, i: F.struct(
        i.alias("pos"), p["block"].alias("block"), p["anchors"].alias("anchors"), F.get(F.get(ps, i + 1)["anchors"], F.lit(0)).alias("following"))))
    rows = pages.select(*keep, F.explode(numbered).alias("_b"))
    return rows.select(*keep, "_b.pos", "_b.block", "_b.anchors", "_b.following")


def listing_blocks(pages: DataFrame, layout: ListingLayout = ListingLayout()) -> DataFrame:
    """One row per listing block with its position in the page and the block after it."""
    keep = [c for c in pages.columns if c != "html"]
    numbered = bind(
        split_blocks(F.col("html"), layout.start),
        lambda blocks: F.transform(
            blocks,
            lambda b, i: F.struct(i.alias("pos"), b.alias("block"), F.get(blocks, i + 1).alias("next_block")),
        ),
    )
    rows = pages.select(*keep, F.explode(numbered).alias("_b"))
    return rows.select(*keep, "_b.pos", "_b.block", "_b.next_block")


def _is_pdf(anchor: Column) -> Column:
    text = F.lower(normalize_text_u(F.regexp_replace(anchor["body"], lexicon.TAG, " ")))
    return F.lower(anchor["href"]).endswith(".pdf") | (text == "pdf")


def _nearby_pdf(own: Column, following: Column) -> Column:
    """Href of the first pdf link among the next anchors, the first anchor of the
    following title included."""
    all_of_them = F.concat(own, F.filter(F.array(following), lambda a: a.isNotNull()))
    window = F.slice(all_of_them, 1, lexicon.PDF_ANCHOR_WINDOW)
    return F.get(F.filter(window, _is_pdf), F.lit(0))["href"]


def _suffix_pdf(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, lexicon.PDF_HREF, 1), F.lit(""))


def listing_papers(pages: DataFrame, layout: ListingLayout = ListingLayout()) -> DataFrame:
    """One raw record per listing block; blocks without a titled link are skipped.

    ``pages`` has ``url`` as the base of relative links; other columns, such as
    ``year``, are kept.
    """
    blocks = _anchored_blocks(pages, layout)
    keep = [c for c in pages.columns if c not in ("html", "url")]
    first = F.get("anchors", F.lit(0))
    if layout.author_rule == "values":
        values = F.regexp_extract_all("block", F.lit(layout.authors), F.lit(1))
        authors = unique_clean(F.split(unescape(F.concat_ws("\u0001", values)), "\u0001"))
    else:
        authors = parse_authors(clean_html(F.regexp_extract("block", layout.authors, 1)))
    pdf = _suffix_pdf(F.col("block")) if layout.pdf_rule == "suffix" else _nearby_pdf(F.col("anchors"), F.col("following"))
    # All that may need Python is asked for side by side, so that a task has one worker; behind
    # the generator the filter is not pushed below, which would ask for the title twice.
    record = F.struct(
        clean_html(first["body"]).alias("title"), authors.alias("authors"),
        resolve_url(F.col("url"), first["href"], escaped=True).alias("paper_url"),
        F.coalesce(resolve_url(F.col("url"), pdf, escaped=True), F.lit("")).alias("pdf_url"),
    )
    named = blocks.select(*keep, "pos", record.alias("_r")).select(*keep, "pos", F.explode(F.array("_r")).alias("_r"))
    return named.select(*keep, "pos", "_r.title", "_r.authors", "_r.paper_url", "_r.pdf_url").where(F.col("title") != "")


def detail_fields(pages: DataFrame, layout: DetailLayout = DetailLayout()) -> DataFrame:
    """``(paper_url, abstract, pdf_url)`` of detail pages; other columns are kept."""
    keep = [c for c in pages.columns if c not in ("html", "url")]
    inside = F.regexp_extract("html", layout.abstract, layout.group) if layout.group else element_body(F.col("html"), layout.abstract)
    pages = pages.withColumn("_inside", inside)
    body = clean_html(F.col("_inside"))
    label = r"(?i)^abstract\s*" if layout.any_case_label else r"^Abstract\s*"
    if layout.pdf_rule == "suffix":
        pdf = _suffix_pdf(F.col("html"))
    else:
        pdf = F.get(F.filter(anchors(F.col("html")), _is_pdf), F.lit(0))["href"]
    return pages.select(
        *keep, F.col("url").alias("paper_url"),
        F.trim(F.regexp_replace(body, label, "")).alias("abstract"),
        F.coalesce(resolve_url(F.col("url"), pdf, escaped=True), F.lit("")).alias("pdf_url"),
    )


def link_rows(pages: DataFrame, pattern: str = lexicon.HREF, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per link of each page, in page order."""
    return pages.select(*keep, F.posexplode(page_links(F.col("html"), pattern)).alias("pos", "href"))

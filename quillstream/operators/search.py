"""Filtered, paged search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from quillstream import lexicon
from quillstream.functions.text import contains_pattern, fold_text, folded
from quillstream.operators.ranks import By, by, page

# Beyond this many rows a page is located on its keys instead of by a top-k, whose
# single merge would hold every row up to the page. Both give the same rows.
DEEP_PAGE = 1_000


def like_pattern(q: str) -> str:
    """``%q%`` with the backslash escaping wildcards and itself; before any other
    character it stands for that character."""
    return re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{q}%", flags=re.DOTALL)


def matches(q: str = "", year: int = 0, fold_accents: bool = False) -> Column:
    """Conjunction of the predicates that were given; true when none was.

    Text matching ignores case and lets ``%`` and ``_`` act as wildcards;
    ``fold_accents`` also ignores accents.
    """
    condition = F.lit(True)
    if q:
        if fold_accents:
            pattern = contains_pattern(folded(q))
            text = fold_text(F.col("title")).rlike(pattern) | fold_text(F.col("abstract")).rlike(pattern)
        else:
            pattern = like_pattern(q)
            text = F.col("title").ilike(pattern) | F.col("abstract").ilike(pattern)
        condition = condition & text
    if year > 0:
        condition = condition & (F.col("year") == F.lit(year))
    return condition


def search_total(papers: DataFrame, q: str = "", year: int = 0, **options) -> DataFrame:
    return papers.where(matches(q, year, **options)).agg(F.count("*").alias("total"))


def search_page(papers: DataFrame, q: str = "", year: int = 0, limit: int = lexicon.SEARCH_LIMIT, offset: int = 0,
                deep_page: int = DEEP_PAGE, **options) -> DataFrame:
    """One page, newest year and id first; where ids repeat, the largest source_id first, as in ``search_after``.

    Near pages are a top-(offset + limit) of whole rows; far ones are located on
    their keys, and only the rows of the page are read whole.
    """
    _check_paging(limit, offset)
    found = papers.where(matches(q, year, **options))
    if offset + limit > deep_page:
        return page(found, _newest(found), offset, limit)
    found = found.orderBy(*[o.column() for o in _newest(found)])
    return found.offset(offset).limit(limit) if offset else found.limit(limit)


def _newest(papers: DataFrame) -> list[By]:
    return by(*[c for c in ("year", "id", "source_id") if c in papers.columns], descending=True)


def search_after(papers: DataFrame, after_year: int, after_id: int, q: str = "", year: int = 0,
                 limit: int = lexicon.SEARCH_LIMIT, after_key: str | None = None, deep_page: int = DEEP_PAGE, **options) -> DataFrame:
    """The page that follows ``(after_year, after_id)``: its cost does not grow with depth.

    Where ids repeat, ``after_key``, the source_id of the last row, tells them apart.
    A page of more than ``deep_page`` rows is located on its keys, as in ``search_page``.
    """
    _check_paging(limit, 0)
    y, i = F.col("year"), F.col("id")
    later = i < after_id
    if after_key is not None:
        later = later | ((i == after_id) & (F.col("source_id") < after_key))
    beyond = (y <= after_year) & ((y < after_year) | later)
    found = papers.where(matches(q, year, **options) & beyond)
    if limit > deep_page:
        return page(found, _newest(found), 0, limit)
    return found.orderBy(*[o.column() for o in _newest(found)]).limit(limit)


def page_meta(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """Envelope of a page: total, limits, has-previous, has-next and a range text."""
    _check_paging(limit, offset)
    count = F.col("total")
    start = F.when(count == 0, F.lit(0)).otherwise(F.lit(offset + 1)).cast("bigint")
    end = F.least(F.lit(offset + limit).cast("bigint"), count)
    return total.select(
        "total",
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(offset).cast("bigint").alias("offset"),
        F.lit(offset > 0).alias("has_prev"),
        (F.lit(offset + limit) < count).alias("has_next"),
        F.concat(start, F.lit("-"), end, F.lit(" / "), count).alias("range_text"),
    )


def search(papers: DataFrame, q: str = "", year: int = 0, limit: int = lexicon.SEARCH_LIMIT, offset: int = 0,
           **options) -> dict[str, DataFrame]:
    """Items and envelope of one search request, both lazy."""
    return {
        "items": search_page(papers, q, year, limit, offset, **options),
        "meta": page_meta(search_total(papers, q, year, **options), limit, offset),
    }


def request_int(value: str | None, default: int) -> int:
    """A request parameter as a number; anything else falls back to the default."""
    return int(value) if value is not None and re.fullmatch(r"[+-]?[0-9]+", value) else default


def _check_paging(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")

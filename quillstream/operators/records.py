"""Producer side: normalise, enrich, order, cap per year, emit only new records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quillstream import lexicon
from quillstream.functions.keywords import extract_keywords
from quillstream.functions.text import normalize_text_u, stable_id, text_or_empty, unique_clean
from quillstream.operators.perkey import first_n_per_group, first_per_key
from quillstream.operators.skew import salted_join
from quillstream.schemas import PAPER_EVENT

_TEXTS = ["abstract", "source_id", "paper_url", "pdf_url", "crawled_at"]
_LISTS = ["authors", "institutions", "keywords"]


def _with_missing(df: DataFrame) -> DataFrame:
    for name in _TEXTS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    for name in _LISTS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("array<string>"))
    return df


def normalize_papers(papers: DataFrame, now: Column, prefix: str = lexicon.ID_PREFIX,
                     keyword_limit: int = lexicon.KEYWORDS_PER_RECORD) -> DataFrame:
    """Canonical records from raw ones. Extra columns are kept.

    Supplied keywords win; a record without any gets extracted ones.
    """
    raw = _with_missing(papers)
    extra = [c for c in raw.columns if c not in PAPER_EVENT.names]
    cleaned = raw.select(
        *extra,
        F.col("year").cast("int").alias("year"),
        normalize_text_u(F.col("title")).alias("title"),
        normalize_text_u(F.col("abstract")).alias("abstract"),
        unique_clean(F.col("authors")).alias("authors"),
        unique_clean(F.col("institutions")).alias("institutions"),
        unique_clean(F.transform(F.col("keywords"), F.lower)).alias("_given"),
        *[c for c in ("source_id", "paper_url", "pdf_url", "crawled_at")],
    )
    text = F.concat_ws(" ", "title", "abstract")
    keywords = F.when(F.size("_given") > 0, F.col("_given")).otherwise(extract_keywords(text, keyword_limit))
    given_id = F.nullif("source_id", F.lit(""))
    return cleaned.select(
        *extra,
        F.coalesce(given_id, stable_id(F.col("year"), F.col("title"), prefix)).alias("source_id"),
        "year", "title", "authors", "institutions", "abstract",
        keywords.alias("keywords"),
        text_or_empty(F.col("paper_url")).alias("paper_url"),
        text_or_empty(F.col("pdf_url")).alias("pdf_url"),
        F.coalesce(F.nullif("crawled_at", F.lit("")), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("crawled_at"),
    )


def enrich_details(listing: DataFrame, details: DataFrame, keyword_limit: int = lexicon.KEYWORDS_PER_RECORD) -> DataFrame:
    """Abstract, pdf link and keywords from the detail page of each record.

    ``details`` is ``(paper_url, abstract, pdf_url)``; a record without one is
    unchanged. Details are reduced to one per url before the join, and records
    without a url skip it, so a blank or hot url never multiplies rows; records of
    a url that very many share are dealt out to several tasks.
    """
    detail = first_per_key(
        details.where(F.col("paper_url") != "").select("paper_url", "abstract", "pdf_url"),
        ["paper_url"], ["abstract", "pdf_url"],
    ).select(
        F.col("paper_url").alias("_url"),
        text_or_empty(F.col("abstract")).alias("_abstract"),
        text_or_empty(F.col("pdf_url")).alias("_pdf"),
    )
    has_url = F.coalesce(F.col("paper_url"), F.lit("")) != ""
    joined = salted_join(listing.where(has_url), detail, "paper_url", "_url")
    found = F.col("_url").isNotNull()
    text = F.concat_ws(" ", "title", "_abstract")
    replaced = {
        "abstract": F.when(found, F.col("_abstract")).otherwise(F.col("abstract")),
        "pdf_url": F.when(found, F.coalesce(F.nullif("pdf_url", F.lit("")), "_pdf")).otherwise(F.col("pdf_url")),
        "keywords": F.when(found, extract_keywords(text, keyword_limit)).otherwise(F.col("keywords")),
    }
    enriched = joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in listing.columns])
    return enriched.unionByName(listing.where(~has_url))


def emit_new_only(batch: DataFrame, seen: DataFrame, order: list[str], key: str = "source_id") -> DataFrame:
    """First record of each id that was never emitted before."""
    return first_per_key(batch, [key], order).join(seen.select(key).distinct(), key, "left_anti")


def limit_per_year(papers: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` records of each year in page order; 0 keeps all."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return papers if n == 0 else first_n_per_group(papers, "year", order, n)


def crawl_order(batches: list[DataFrame], tie: str) -> DataFrame:
    """Bag union of per-year batches, newest year first, then title."""
    return reduce(DataFrame.unionByName, batches).orderBy(F.desc("year"), "title", tie)


def cycle_counts(batch: DataFrame, seen: DataFrame, key: str = "source_id") -> DataFrame:
    """Discovered, new and seen counts of one cycle, as one row."""
    known = seen.select(key).distinct()
    new = batch.select(key).distinct().join(known, key, "left_anti").agg(F.count("*").alias("n"))
    seen_before = known.agg(F.count("*").alias("n"))
    discovered = batch.agg(F.count("*").alias("discovered"))
    return discovered.select(
        "discovered",
        new.scalar().alias("new"),
        (seen_before.scalar() + new.scalar()).alias("seen"),
    )


def observe_cycle(batch: DataFrame, name: str = "cycle") -> tuple[DataFrame, Observation]:
    """Count records and years as the batch flows by, without a job of its own."""
    watch = Observation(name)
    return batch.observe(watch, F.count("*").alias("processed"), F.min("year").alias("first_year"),
                         F.max("year").alias("last_year")), watch


def to_messages(papers: DataFrame, key: str = "source_id", pretty: bool = False) -> DataFrame:
    """Keyed message rows: the id and the record as JSON text."""
    options = {"ignoreNullFields": "false"}
    if pretty:
        options["pretty"] = "true"
    return papers.select(F.col(key).alias("key"), F.to_json(F.struct("*"), options).alias("value"))

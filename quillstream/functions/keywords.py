"""Keyword extraction as a per-row expression: no shuffle, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillstream import lexicon
from quillstream.functions.arrays import bind, run_lengths
from quillstream.functions.text import text_or_empty


def keyword_text(c: Column) -> Column:
    """Lower-cased text with separators and other punctuation as spaces.

    Not collapsed afterwards: ``few - shot`` keeps three spaces.
    """
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), "[-_/]+", " ")
    return F.regexp_replace(spaced, r"(?U)[^a-z0-9\s\x1c-\x1f]+", " ")


def tokens(c: Column) -> Column:
    """Every token occurrence.

    The clean-up of ``keyword_text`` only swaps token breaks for token breaks,
    so the tokens of the lower-cased text are the same and it is skipped here.
    """
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(lexicon.TOKEN_PATTERN), F.lit(0))


def phrase_hits(c: Column, phrases: list[str] | None = None) -> Column:
    """Phrases the text contains, each once, in dictionary order.

    The clean-up of ``keyword_text`` never joins or changes what it leaves between
    spaces, so a text without a phrase's longest word is not cleaned for it.
    """
    phrases = lexicon.PHRASES if phrases is None else phrases
    listed = F.array(*[F.lit(p) for p in phrases]).cast("array<string>")
    longest = F.array(*[F.lit(max(p.split(" "), key=len)) for p in phrases]).cast("array<string>")
    possible = bind(F.lower(text_or_empty(c)), lambda text: F.filter(listed, lambda _, i: F.contains(text, F.get(longest, i))))
    return bind(possible, lambda some: F.when(F.size(some) == 0, some).otherwise(
        bind(keyword_text(c), lambda text: F.filter(some, lambda p: F.contains(text, p)))))


def term_scores(
    c: Column,
    limit: int = lexicon.KEYWORDS_PER_RECORD,
    phrases: list[str] | None = None,
    stopwords: list[str] | None = None,
    phrase_score: int = lexicon.PHRASE_SCORE,
) -> Column:
    """Top terms as ``array<struct<neg_count, item>>``, best first, ties by name.

    A phrase enters the term list ``phrase_score`` times and a token once per
    occurrence; counting the runs of the sorted list adds the scores up.
    """
    phrases = lexicon.PHRASES if phrases is None else phrases
    stopwords = lexicon.STOPWORDS if stopwords is None else stopwords
    words = tokens(c)
    if set(stopwords) & set(phrases):
        # A listed phrase is never a stopword, only the bare token is.
        words = F.filter(words, lambda w: ~w.isin(stopwords))
        dropped = []
    else:
        dropped = stopwords
    weighted = F.flatten(F.transform(phrase_hits(c, phrases), lambda p: F.array_repeat(p, phrase_score)))
    runs = run_lengths(F.sort_array(F.concat(words, weighted)))
    if dropped:
        runs = F.filter(runs, lambda r: ~r["item"].isin(dropped))
    return F.slice(F.sort_array(runs), 1, limit)


def extract_keywords(c: Column, limit: int = lexicon.KEYWORDS_PER_RECORD, **options) -> Column:
    return F.transform(term_scores(c, limit, **options), lambda r: r["item"])

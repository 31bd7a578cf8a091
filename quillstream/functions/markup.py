"""Markup cleaning and link resolution."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from quillstream import lexicon
from quillstream.functions.arrays import bind
from quillstream.functions.text import normalize_text_u, text_or_empty

# Entities replaced natively; '&amp;' must come last so nothing is decoded twice.
_NATIVE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"),
                    ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
_OTHER_ENTITY = "&(?!(?:lt|gt|quot|#39|copy|middot|nbsp|amp);|[^A-Za-z#]|$)"


@F.pandas_udf(StringType())
def _unescape_rare(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _join_url(base: pd.Series, ref: pd.Series, escaped: pd.Series) -> pd.Series:
    return pd.Series([
        None if b is None or r is None else urljoin(b, html.unescape(r) if e else r) for b, r, e in zip(base, ref, escaped)
    ], dtype=object)


def strip_tags(c: Column) -> Column:
    """Tags to spaces, whitespace folded; entities left as they are."""
    return normalize_text_u(F.regexp_replace(text_or_empty(c), lexicon.TAG, " "))


def unescape(c: Column) -> Column:
    """HTML unescape: common entities natively, rows with any other in Python.

    Rows the native branch covers send only a null across the Arrow boundary.
    """
    return F.coalesce(_unescape_rare(F.when(c.rlike(_OTHER_ENTITY), c)), _unescape_common(c))


def _unescape_common(c: Column) -> Column:
    for entity, char in _NATIVE_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_html(c: Column) -> Column:
    return normalize_text_u(unescape(F.regexp_replace(text_or_empty(c), lexicon.TAG, " ")))


def element_body(c: Column, opening: str) -> Column:
    """What the first element whose opening tag matches holds, nested elements of the same name included.

    Group 1 of ``opening`` is the tag's name. From there on the text is cut at the
    tags of that name, and their depth is counted until it is back at zero. An
    element that is never closed reaches to the end; without a match it is ``''``.
    """
    name = F.lower(F.regexp_extract(c, opening, 1))
    rest = F.get(F.split(c, opening, 2), F.lit(1))
    tag = F.concat(F.lit("(?is)(?=</?"), name, F.lit(r"[\s/>])"))

    def body(found: Column) -> Column:
        # '</div' closes, '<div ../>' does neither, any other '<div' opens
        closes, opens = F.concat(F.lit("(?is)^</"), found["name"], F.lit(r"[\s/>]")), F.concat(F.lit("(?is)^<"), found["name"], F.lit(r"(?:\s[^>]*)?(?<!/)>"))
        step = lambda piece: F.when(F.rlike(piece, closes), -1).when(F.rlike(piece, opens), 1).otherwise(0)
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

        def walk(acc: Column, piece: Column) -> Column:
            depth = acc["depth"] + step(piece)
            end = F.when((acc["end"] < 0) & (depth <= 0), acc["at"]).otherwise(acc["end"])
            return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), end.alias("end"))

        end = F.aggregate(found["pieces"], start, walk, lambda acc: F.when(acc["end"] < 0, acc["at"]).otherwise(acc["end"]))
        return F.array_join(F.slice(found["pieces"], F.lit(1), end), "")

    inside = bind(F.struct(name.alias("name"), F.split(rest, tag, -1).alias("pieces")), body)
    return F.when(rest.isNull(), F.lit("")).otherwise(inside)


def anchors(c: Column) -> Column:
    """``array<struct<href, body>>`` of every anchor, in page order."""
    hrefs = F.regexp_extract_all(c, F.lit(lexicon.ANCHOR), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(lexicon.ANCHOR), F.lit(2))
    return F.zip_with(hrefs, bodies, lambda h, b: F.struct(h.alias("href"), b.alias("body")))


def page_links(c: Column, pattern: str = lexicon.HREF) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def resolve_url(base: Column, ref: Column, escaped: bool = False) -> Column:
    """Absolute, root-relative and empty references natively, the rest by ``urljoin``.

    An ``escaped`` reference is unescaped first, where needed in the same Python
    function: one that took the outcome of another would need a second worker for
    each task.
    """
    rare = F.coalesce(ref.rlike(_OTHER_ENTITY), F.lit(False)) if escaped else F.lit(False)
    if escaped:
        ref = F.when(rare, ref).otherwise(_unescape_common(ref))
    # Dot segments, blanks and an empty query or fragment need the full rules.
    plain = ~ref.rlike(r"(^|/)\.\.?(/|[?#]|$)|[\x00-\x20]|[?#]$|[?]#")
    absolute = ref.rlike(r"^https?://[^/?#]+") & plain
    rooted = ref.rlike(r"^/([^/]|$)") & plain
    origin = F.regexp_extract(base, r"^https?://[^/?#]+", 0)
    native = F.when(ref == "", base).when(absolute, ref).when(rooted & (origin != ""), F.concat(origin, ref))
    native = F.when(~rare, native)
    rest = native.isNull()
    joined = _join_url(F.when(rest, base), F.when(rest, ref), rare)
    return F.coalesce(native, joined)

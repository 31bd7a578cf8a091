"""Text cleaning, list cleaning, ids and instants."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from quillstream import lexicon
from quillstream.functions.arrays import distinct_by

# Every character up to U+0020, the set a JVM trim removes.
_CONTROL = "".join(chr(i) for i in range(0x21))

# Unicode whitespace plus the four separators U+001C..U+001F, which Python's
# str.split treats as whitespace and the Unicode property does not.
_WIDE_SPACE = r"(?U)[\s\x1c-\x1f]+"

_ZULU = r"(?i)\A[+-]?\d{4,10}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z\z"
_ZULU_OR_OFFSET = r"(?i)\A[+-]?\d{4,10}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:?\d\d)\z"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Stream rule: strip control characters at the ends, fold ASCII whitespace."""
    return F.regexp_replace(F.btrim(text_or_empty(c), F.lit(_CONTROL)), r"\s+", " ")


def normalize_text_u(c: Column) -> Column:
    """Producer rule: fold and strip Unicode whitespace."""
    return F.trim(F.regexp_replace(text_or_empty(c), _WIDE_SPACE, " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"\A\p{javaWhitespace}*\z")


def clean_list(values: Column) -> Column:
    """Stream rule: normalise, drop blanks, exact distinct keeping order."""
    items = F.coalesce(values, F.array().cast("array<string>"))
    # After trimming, an ASCII first character settles it without the pattern.
    return F.array_distinct(F.filter(
        F.transform(items, normalize_text),
        lambda x: (x != "") & (F.ascii(x).between(0x21, 0x7E) | ~is_blank(x)),
    ))


def unique_clean(values: Column) -> Column:
    """Producer rule: normalise, drop blanks, first spelling of each lower-cased value."""
    items = F.coalesce(values, F.array().cast("array<string>"))
    present = F.filter(F.transform(items, normalize_text_u), lambda x: x != "")
    return distinct_by(present, F.lower)


def parse_authors(c: Column) -> Column:
    joined = F.regexp_replace(normalize_text_u(c), r"\s+and\s+", ", ")
    return unique_clean(F.split(joined, ",", -1))


def stable_id(year: Column, title: Column, prefix: str = lexicon.ID_PREFIX) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    year_text = year.cast("string")
    digest = F.sha1(F.concat(year_text, F.lit(":"), title).cast("binary"))
    return F.concat_ws(
        "-",
        F.lit(prefix),
        year_text,
        F.substring(slug, 1, lexicon.SLUG_LENGTH),
        F.substring(digest, 1, lexicon.DIGEST_LENGTH),
    )


def parse_instant(c: Column, now: Column, strict: bool = False) -> Column:
    """ISO instant, else ``now``. ``strict`` accepts only the ``Z`` form.

    ``now`` is passed in so that a replayed batch gives the same rows.
    """
    pattern = _ZULU if strict else _ZULU_OR_OFFSET
    return F.coalesce(F.when(c.rlike(pattern), F.try_to_timestamp(c)), now)


def fold_key(c: Column, collation: str | None) -> Column:
    """Grouping key under a collation, or the value itself (binary equality)."""
    return F.collate(c, collation) if collation else c


def _plain(ch: str) -> str | None:
    """A letter without its marks, or None for one that has none."""
    parts = unicodedata.normalize("NFD", ch)
    return parts[0] if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]) else None


# Lower-case letters with marks, by rule from the blocks of Latin, Greek and Cyrillic letters.
_MARKED = {chr(c): _plain(chr(c)) for low, high in ((0xC0, 0x530), (0x1E00, 0x2000)) for c in range(low, high) if chr(c).islower() and _plain(chr(c))}


def fold_text(c: Column) -> Column:
    """Lower case without accents, ``ß`` as ``ss``: equal for texts that differ in those only."""
    plain = F.translate(F.lower(c), "".join(_MARKED), "".join(_MARKED.values()))
    return F.replace(F.regexp_replace(plain, r"\p{Mn}+", ""), F.lit("ß"), F.lit("ss"))


def collation_key(c: Column) -> Column:
    """Key under which spellings are one value: case, accents and trailing blanks do not count."""
    return fold_text(F.rtrim(c))


def folded(text: str) -> str:
    """``fold_text`` of a value at hand."""
    marks = "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(ch))
    return unicodedata.normalize("NFC", marks).replace("ß", "ss")


def contains_pattern(q: str) -> str:
    """Regular expression that finds ``%q%`` of LIKE: ``%`` any text, ``_`` one code point, a backslash before
    them or itself takes them literally.

    The pieces between ``%`` are met from left to right, each at its first place behind
    the one before, and kept there: if any way through a text exists that one does,
    so none is given up and the time is linear in the text.
    """
    pieces, literal = [""], False
    for ch in q:
        if ch == "\\" and not literal:
            literal = True
            continue
        if literal or ch not in "%_":
            pieces[-1] += f"\\x{ord(ch):02x}" if ord(ch) < 128 else ch
        elif ch == "_":
            pieces[-1] += "."
        else:
            pieces.append("")
        literal = False
    return "(?s)^" + "".join(f"(?>.*?{p})" for p in pieces if p)

"""Operator 12: fill-in-the-middle by rotating blocks in place.

A text is cut twice, between units. Sentinels go into one bytearray in the order
prefix, middle, suffix; an exchange of two neighbouring blocks, as three reversals,
brings the suffix forward. The same rotation undoes it, so a text comes back from
its output and form alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillstream.llm.common import map_rows

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that are looked at, or swapped, at a time.
BLOCK = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Turn ``view[start:end]`` round where it stands, a block from either side at a time."""
    while end - start > 1:
        width = min(BLOCK, (end - start) // 2)
        head = view[start:start + width].copy()
        view[start:start + width] = view[end - width:end][::-1]
        view[end - width:end] = head[::-1]
        start, end = start + width, end - width


def rotate(view: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks ``[start, middle)`` and ``[middle, end)``."""
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


class Units:
    """Units of a UTF-8 text: runs of ASCII letters, any other code point alone."""

    def __init__(self, text: bytes):
        self.bytes = np.frombuffer(text, dtype=np.uint8)
        self.before = [0]
        for start in range(0, len(text), BLOCK):
            self.before.append(self.before[-1] + int(np.count_nonzero(self._starts(start))))

    def _starts(self, start: int) -> np.ndarray:
        part = self.bytes[start:start + BLOCK]
        letter = _LETTER[part]
        inside = (part & 0xC0) == 0x80
        inside[1:] |= letter[1:] & letter[:-1]
        if start:
            inside[0] |= letter[0] & _LETTER[self.bytes[start - 1]]
        return ~inside

    def __len__(self) -> int:
        return self.before[-1]

    def place(self, unit: int) -> int:
        """The byte at which a unit starts; the text's end for the number of units."""
        if unit == len(self):
            return len(self.bytes)
        block = int(np.searchsorted(self.before, unit, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._starts(block * BLOCK))[unit - self.before[block]])

    def code_points(self, start: int, end: int) -> int:
        return sum(int(np.count_nonzero((self.bytes[i:min(i + BLOCK, end)] & 0xC0) != 0x80)) for i in range(start, end, BLOCK))


def shuffled(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output of a text cut at two byte places."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(out, dtype=np.uint8)
    rotate(view, middle if form == "psm" else 0, suffix, len(out))
    return out


def restored_text(output: bytes, form: str) -> bytes:
    """The text that an output was made of. No sentinel occurs but the three that were inserted."""
    if form == "plain":
        return output
    out = bytearray(output)
    prefix, suffix, middle = (out.find(s) for s in (PREFIX, SUFFIX, MIDDLE))
    view = np.frombuffer(out, dtype=np.uint8)
    if form == "psm":
        rotate(view, suffix, middle, len(out))
        middle, suffix = suffix, suffix + len(out) - middle
    else:
        rotate(view, suffix, prefix, len(out))
        middle, suffix = middle - prefix, len(out) - prefix
    del view
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del out[at:at + len(sentinel)]
    return bytes(out)


def draws(key: Column, epoch: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers that the epoch and a document's id decide; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, epoch: int = 1, rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each row.

    ``n`` counts units. Of 100 texts ``rate`` are cut, of those ``suffix_first``
    have the suffix first (spm), the rest the prefix (psm). A text that is null,
    empty or holds a sentinel stays plain, with null counts of characters. Ids may
    repeat or be null: rows are told apart by nothing, equal rows have equal
    results. Other columns are left out. No rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col("doc_id"), epoch))])

    def make():
        def one(text, h1, h2, h3, h4):
            units = Units(text)
            n = len(units)
            if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                return n, "plain", None, None, text
            form = "spm" if h4 % 100 < suffix_first else "psm"
            first, second = (units.place(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
            return n, form, units.code_points(0, first), units.code_points(first, second), bytes(shuffled(text, first, second, form))

        def work(batch):
            made = [one(*r) for r in zip(*(batch[c] for c in ("text", "h1", "h2", "h3", "h4")))]
            columns = list(zip(*made)) or [()] * 5
            return {"doc_id": batch["doc_id"]} | dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), map(list, columns)))
        return work

    made = map_rows(rows, make, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` of :func:`transform` with the column ``restored``: the texts rebuilt from ``output`` and ``form``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in outputs.dtypes if c not in ("output", "restored"))
    rows = outputs.drop("restored").withColumn("output", F.col("output").cast("binary"))

    def make():
        def work(batch):
            return batch | {"restored": [restored_text(o, f) for o, f in zip(batch["output"], batch["form"])]}
        return work

    back = map_rows(rows, make, f"{schema}, output binary, restored binary")
    return back.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of :func:`transform` and back."""
    return restored(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same in DuckDB, by concatenation.
SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::BIGINT AS h1,
         ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 9, 8))::UBIGINT::BIGINT AS h2,
         ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 17, 8))::UBIGINT::BIGINT AS h3,
         ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 25, 8))::UBIGINT::BIGINT AS h4
  FROM documents),
cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM parts),
found AS (SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
                        ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM found"""

"""Change log projection, notifications and incremental pulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstream import lexicon
from quillstream.operators.ranks import by, page
from quillstream.operators.search import DEEP_PAGE

# Position of each field in a logged row; the eighth column is not exposed.
_POSITIONS = {
    "id": (0, "bigint"), "source_id": (1, "string"), "year": (2, "bigint"), "title": (3, "string"),
    "abstract": (4, "string"), "paper_url": (5, "string"), "pdf_url": (6, "string"),
    "created_at": (8, "timestamp"), "updated_at": (9, "timestamp"),
}
ROW_WIDTH = 10


def change_rows(log: DataFrame, schema: str, table: str, start: int = -1) -> DataFrame:
    """After-images of one table, from a log position onward.

    ``log`` is ``(seq, schema_name, table_name, op, row_index, image)``; an
    update logs its before-image at even and its after-image at odd indexes.
    """
    wanted = (F.col("schema_name") == schema) & (F.col("table_name") == table) & (F.col("seq") > start)
    before = (F.col("op") == "update") & (F.col("row_index") % 2 == 0)
    return log.where(wanted & (F.col("op") != "delete") & ~before)


def project_images(rows: DataFrame, now: Column, image: str = "image") -> DataFrame:
    """Positional image to named columns, with defaults '', 0 and ``now``.

    Images narrower than ten values are dropped.
    """
    values = F.col(image)
    fields = []
    for name, (position, kind) in _POSITIONS.items():
        value = F.get(values, F.lit(position))
        if kind == "string":
            typed = F.coalesce(value, F.lit(""))
        elif kind == "bigint":
            typed = F.coalesce(value.try_cast("int" if name == "year" else "bigint"), F.lit(0))
        else:
            typed = F.coalesce(value.try_cast("timestamp"), now)
        fields.append(typed.alias(name))
    return rows.where(F.size(values) >= ROW_WIDTH).select("seq", *fields)


def change_events(papers: DataFrame, key: str | None = None) -> DataFrame:
    """Notification text per changed record."""
    body = F.struct(F.lit(lexicon.CHANGE_EVENT).alias("type"), F.struct("*").alias("payload"))
    text = F.to_json(body, {"ignoreNullFields": "false"}).alias("event")
    return papers.select(*([key] if key else []), text)


def updated_after(papers: DataFrame, after: Column, after_id: Column | None = None, limit: int = lexicon.POLL_LIMIT,
                  after_key: Column | None = None) -> DataFrame:
    """Oldest changes first beyond a cursor.

    With ``after_id`` the cursor is the pair ``(updated_at, id)``, so rows that
    share the last timestamp are not skipped; without it rows at exactly
    ``after`` are left out. Where ids repeat, ``after_key``, the source_id of the
    last row, tells them apart. More than ``DEEP_PAGE`` rows are located on their
    keys, so that no task merges them all.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    ts = F.col("updated_at")
    if after_id is None:
        beyond = ts > after
    else:
        # The first conjunct is a plain range that reaches the scan.
        later = F.col("id") > after_id
        if after_key is not None:
            later = later | ((F.col("id") == after_id) & (F.col("source_id") > after_key))
        beyond = (ts >= after) & ((ts > after) | later)
    order = by(*[c for c in ("updated_at", "id", "source_id") if c in papers.columns])
    if limit > DEEP_PAGE:
        return page(papers.where(beyond), order, 0, limit)
    return papers.where(beyond).orderBy(*[o.column() for o in order]).limit(limit)


def poll_cursor(pulled: DataFrame, after: Column, after_id: Column, after_key: Column | None = None) -> DataFrame:
    """Cursor to use next: the last pulled pair, or the old one when nothing came; with ``after_key`` its source_id too."""
    old = {"updated_at": after, "id": after_id} | ({} if after_key is None else {"source_id": after_key})
    last = F.max(F.struct(*old))
    return pulled.agg(last.alias("_last")).select(*[F.coalesce(F.col("_last")[name], value).alias(name) for name, value in old.items()])

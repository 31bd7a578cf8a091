"""Views that let general tables play the parts of the engine's own tables.

``catalog``: orders as papers, suppliers as authors, their nations as
institutions, part names as keywords. ``text``: documents as papers.
``messages``: events as a message topic. ``change log``: events as row changes.

Each view has a DataFrame form and an equivalent SQL fragment for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillstream.operators.records import normalize_papers
from quillstream.session import pin_session, spread
from quillstream.sources.files import read_table

NOW = "2026-01-01 00:00:00"


def now_column():
    return F.lit(NOW).cast("timestamp")


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = pin_session(spark), folder

    def _table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def records(self) -> DataFrame:
        """The papers without their texts: orders alone, as each has a customer."""
        return self._table("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), "o_orderkey").alias("source_id"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").alias("updated_at"))

    def papers(self) -> DataFrame:
        orders, customer = self._table("orders"), self._table("customer")
        joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("order-"), "o_orderkey").alias("source_id"),
            F.year("o_orderdate").alias("year"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "c_name").alias("title"),
            F.col("c_mktsegment").alias("abstract"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def _values(self, joined: DataFrame, value: str) -> DataFrame:
        return joined.select(F.concat(F.lit("order-"), "l_orderkey").alias("source_id"), F.col(value).alias("value")).distinct()

    def authors(self) -> DataFrame:
        lines, supplier = self._table("lineitem"), self._table("supplier")
        return self._values(lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), "s_name")

    def institutions(self) -> DataFrame:
        lines, supplier, nation = self._table("lineitem"), self._table("supplier"), self._table("nation")
        placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return self._values(lines.join(placed, F.col("l_suppkey") == F.col("s_suppkey")), "n_name")

    def keywords(self) -> DataFrame:
        lines, part = self._table("lineitem"), self._table("part")
        return self._values(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "p_name")


CATALOG_SQL = {
    "papers_c": """papers_c AS (SELECT o_orderkey AS id, concat('order-', o_orderkey) AS source_id,
        CAST(year(o_orderdate) AS INT) AS year, concat(o_orderpriority, ' ', o_orderstatus, ' ', c_name) AS title,
        c_mktsegment AS abstract, o_orderdate AS updated_at FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "authors_c": """authors_c AS (SELECT DISTINCT concat('order-', l_orderkey) AS source_id, s_name AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "institutions_c": """institutions_c AS (SELECT DISTINCT concat('order-', l_orderkey) AS source_id, n_name AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "keywords_c": """keywords_c AS (SELECT DISTINCT concat('order-', l_orderkey) AS source_id, p_name AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}


def papers_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers: the first line is the title, the whole text the abstract."""
    docs = read_table(pin_session(spark), folder, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("-"), "doc_id").alias("source_id"),
        (F.lit(2020) + F.col("doc_id") % 6).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
    )


def papers_text_spread(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows on enough tasks for CPU-heavy text work."""
    return spread(papers_text(spark, folder), "id")


TEXT_SQL = """papers_t AS (SELECT doc_id AS id, concat(source, '-', doc_id) AS source_id,
    CAST(2020 + doc_id % 6 AS INT) AS year, split_part(text, chr(10), 1) AS title, text AS abstract FROM documents)"""


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("seq"), "ts", "event_type", "value", "props", "user_id", k.alias("k"),
        F.concat(F.lit("u"), "user_id").alias("source_id"),
        (F.lit(2000) + k % 7).cast("int").alias("year"),
    )


EVENTS_SQL = """ev AS (SELECT *, concat('u', user_id) AS source_id, CAST(2000 + k % 7 AS INT) AS year FROM (
    SELECT event_id AS seq, ts, event_type, value, props, user_id,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def message_rows(events: DataFrame) -> DataFrame:
    """``(seq, value)``: each event as wire JSON with untidy text.

    Where ``k % 23 = 5`` the text is cut short and so malformed; where
    ``k % 17 = 0`` the title is blank.
    """
    e = event_rows(events)
    k = F.col("k").cast("string")
    body = F.struct(
        "source_id", "year",
        F.when(F.col("k") % 17 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" \t\n event "))).alias("title"),
        F.array(F.concat(F.lit("a"), (F.col("k") % 10).cast("string")), F.concat(F.lit(" a"), (F.col("k") % 3).cast("string"), F.lit("  ")),
                F.lit(" "), F.concat(F.lit("a"), (F.col("k") % 10).cast("string"))).alias("authors"),
        F.array(F.concat(F.lit("lab  "), (F.col("k") % 5).cast("string"))).alias("institutions"),
        F.concat(F.lit("props "), k).alias("abstract"),
        F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 20).cast("string"))).alias("keywords"),
        F.concat(F.lit("http://example.org/"), "seq").alias("paper_url"),
        F.lit(None).cast("string").alias("pdf_url"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("crawled_at"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    broken = F.substring(text, 1, 40)
    return e.select("seq", F.when(F.col("k") % 23 == 5, broken).otherwise(text).alias("value"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return message_rows(spread(read_table(pin_session(spark), folder, "events"), "event_id"))


# What the messages above hold once parsed; lists as '|'-joined text.
MESSAGES_SQL = EVENTS_SQL + """, parsed AS (SELECT seq, source_id, year,
    CASE WHEN k % 17 = 0 THEN '' ELSE concat(event_type, ' event') END AS title,
    CASE WHEN k % 10 = k % 3 THEN concat('a', k % 10) ELSE concat('a', k % 10, '|a', k % 3) END AS authors,
    concat('lab ', k % 5) AS institutions, concat('props ', k) AS abstract,
    concat(event_type, '|k', k % 20) AS keywords, concat('http://example.org/', seq) AS paper_url, '' AS pdf_url,
    date_trunc('second', ts) AS crawled_at FROM ev WHERE k % 23 <> 5),
    good AS (SELECT * FROM parsed WHERE title <> '')"""


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    return change_rows(read_table(pin_session(spark), folder, "events"))


def change_rows(events: DataFrame) -> DataFrame:
    """Events as row changes: signups insert, errors delete, the rest update.

    Every eleventh ``k`` changes another table; rows are too short where
    ``k % 29 = 3``.
    """
    e = event_rows(events)
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    table = F.when(F.col("k") % 11 == 0, "audit").otherwise("papers")

    def image(title):
        stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        cells = F.array(
            F.col("user_id").cast("string"), F.col("source_id"),
            F.when(F.col("k") % 13 == 0, F.lit("n/a")).otherwise(F.col("year").cast("string")),
            title, F.when(F.col("k") % 2 == 0, F.col("props")), F.lit("http://example.org"), F.lit(None), stamp, stamp,
            F.when(F.col("k") % 19 != 0, stamp),
        ).cast("array<string>")
        return F.when(F.col("k") % 29 == 3, F.slice(cells, 1, 9)).otherwise(cells)

    before, after = image(F.concat(F.lit("old "), "event_type")), image(F.col("event_type"))
    images = F.when(op == "update", F.array(before, after)).otherwise(F.array(after))
    return e.select(
        "seq", F.lit("library").alias("schema_name"), table.alias("table_name"), op.alias("op"),
        F.posexplode(images).alias("row_index", "image"),
    )


CHANGES_SQL = EVENTS_SQL + f""", changed AS (SELECT seq, user_id AS id, source_id,
    CASE WHEN k % 13 = 0 THEN 0 ELSE year END AS year, event_type AS title,
    CASE WHEN k % 2 = 0 THEN props ELSE '' END AS abstract, 'http://example.org' AS paper_url, '' AS pdf_url,
    date_trunc('second', ts) AS created_at,
    CASE WHEN k % 19 = 0 THEN TIMESTAMP '{NOW}' ELSE date_trunc('second', ts) END AS updated_at
    FROM ev WHERE event_type <> 'error' AND k % 11 <> 0 AND k % 29 <> 3)"""


def records_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents through the producer rules: lists cut from the text, ids derived."""
    papers = papers_text_spread(spark, folder)
    raw = papers.select(
        "id", "year", "title", "abstract",
        F.split("abstract", r"\.").alias("authors"),
        F.array(F.split("source_id", "-")[0], F.lit("  Library "), F.lit("library")).alias("institutions"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("Archive"), F.lit("archive "), F.lit("Text Corpus"))).alias("keywords"),
    )
    return normalize_papers(raw, now_column())


def with_sql(*fragments: str) -> str:
    return "WITH " + ", ".join(fragments) + " "

"""Text, list, id and keyword functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream import lexicon
from quillstream.functions import keywords, text
from quillstream.operators.records import cycle_counts, emit_new_only, to_messages
from quillstream.plans.adapters import EVENTS_SQL, NOW, TEXT_SQL, event_rows, papers_text_spread, records_from_text, with_sql
from quillstream.plans.keyword_sql import KEYWORDS_SQL, WIDE_SPACE
from quillstream.session import pin_session, shared_dir, spread
from quillstream.sources.files import read_json_records, read_table

# Pairs common in the texts, so that phrase matching meets real hits.
TEXT_PHRASES = ["the and", "of the", "la de", "der die", *lexicon.PHRASES]


def documents(spark, folder):
    return spread(read_table(pin_session(spark), folder, "documents"), "doc_id")


def _column(make):
    return lambda spark, folder: documents(spark, folder).select("doc_id", *make())


def _joined(values):
    return F.concat_ws("|", values)


def _extract(spark, folder):
    scored = keywords.term_scores(F.concat_ws(" ", "title", "abstract"))
    rows = papers_text_spread(spark, folder).select("source_id", F.posexplode(scored).alias("pos", "t"))
    return rows.select("source_id", F.col("t.item").alias("term"), (-F.col("t.neg_count")).cast("bigint").alias("score"),
                       (F.col("pos") + 1).alias("rank"))


def _phrases(spark, folder):
    hits = keywords.phrase_hits(F.concat_ws(" open-vocabulary ", "text", "source"), TEXT_PHRASES)
    return documents(spark, folder).select("doc_id", F.explode(hits).alias("phrase"))


def _instants(spark, folder):
    e = event_rows(read_table(pin_session(spark), folder, "events"))
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("k") % 4
    raw = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit("+02:00"))).when(k == 2, base).otherwise("zz")
    now = F.lit(NOW).cast("timestamp")
    return e.select("seq", text.parse_instant(raw, now).cast("timestamp_ntz").alias("lenient"),
                    text.parse_instant(raw, now, strict=True).cast("timestamp_ntz").alias("strict"))


def _keyword_arrays(spark, folder):
    papers = papers_text_spread(spark, folder)
    return papers.select("source_id", _joined(keywords.extract_keywords(F.concat_ws(" ", "title", "abstract"))).alias("keywords"))


def _normalized(spark, folder):
    r = records_from_text(spark, folder)
    flat = [_joined(c).alias(c) for c in ("authors", "institutions", "keywords")]
    return r.select("id", "source_id", "year", "title", "abstract", *flat, "paper_url", "pdf_url", "crawled_at")


def _messages(spark, folder):
    r = event_rows(read_table(pin_session(spark), folder, "events"))
    return to_messages(r.select("source_id", "year", "event_type", F.col("seq").alias("position")))


def _json_scan(spark, folder):
    """Events written as JSON lines and read back with a declared schema."""
    e = event_rows(read_table(pin_session(spark), folder, "events")).select("seq", "source_id", "year", "props")
    path = shared_dir(spark, "json")
    e.write.json(path)
    return read_json_records(spark, path, "seq bigint, source_id string, year int, props string")


def _batch_and_seen(spark, folder):
    e = event_rows(read_table(pin_session(spark), folder, "events")).select("source_id", "year", "seq", "event_type")
    return e, e.where((F.col("event_type") == "signup") & (F.col("year") == 2001))


def _emit(spark, folder):
    batch, seen = _batch_and_seen(spark, folder)
    return emit_new_only(batch, seen, ["seq"])


def _cycle(spark, folder):
    batch, seen = _batch_and_seen(spark, folder)
    return cycle_counts(batch, seen)


QUERIES = {
    "normalize_text": _column(lambda: [text.normalize_text(F.col("text")).alias("clean")]),
    "normalize_text_u": _column(lambda: [text.normalize_text_u(F.col("text")).alias("clean")]),
    "clean_list": _column(lambda: [_joined(text.clean_list(F.split("text", "[.,]"))).alias("items")]),
    "unique_clean": _column(lambda: [_joined(text.unique_clean(F.split("text", "[., ]"))).alias("items")]),
    "parse_authors": _column(lambda: [_joined(text.parse_authors(F.col("text"))).alias("authors")]),
    "stable_id": lambda s, d: papers_text_spread(s, d).select("id", text.stable_id(F.col("year"), F.col("title")).alias("stable_id")),
    "parse_instant": _instants,
    "extract_keywords": _extract,
    "keywords_array": _keyword_arrays,
    "phrase_hits": _phrases,
    "normalize_papers": _normalized,
    "to_messages": _messages,
    "json_file_scan": _json_scan,
    "emit_new_only": _emit,
    "cycle_counts": _cycle,
}

def _norm_u(expr):
    return f"trim(regexp_replace({expr}, '[{WIDE_SPACE}]+', ' ', 'g'))"


def _norm(expr):
    """The control characters a JVM trim strips, then the JVM's ASCII whitespace."""
    trimmed = rf"regexp_replace({expr}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    return rf"regexp_replace({trimmed}, '[ \t\n\x0b\f\r]+', ' ', 'g')"


_KW = with_sql(TEXT_SQL, KEYWORDS_SQL.format(source="papers_t", key="source_id", text="concat(title, ' ', abstract)"))


def _unique_sql(items, key):
    """First spelling of each lower-cased item, in order, as joined text."""
    return f"""per AS (SELECT {key} AS key, unnest({items}) AS raw, unnest(range(len({items}))) AS pos FROM src),
        kept AS (SELECT key, item, min(pos) AS pos FROM (SELECT key, pos, {_norm_u('raw')} AS item FROM per) WHERE item <> ''
            GROUP BY key, item),
        firsts AS (SELECT key, arg_min(item, pos) AS item, min(pos) AS pos FROM kept GROUP BY key, lower(item)),
        lists AS (SELECT key, string_agg(item, '|' ORDER BY pos) AS joined FROM firsts GROUP BY key)"""


ORACLE = {
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS clean FROM documents",
    "normalize_text_u": f"SELECT doc_id, {_norm_u('text')} AS clean FROM documents",
    "clean_list": f"""WITH per AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM
            (SELECT doc_id, regexp_split_to_array(text, '[.,]') AS parts FROM documents)),
        kept AS (SELECT doc_id, item, min(pos) AS pos FROM (SELECT doc_id, pos, {_norm('raw')} AS item FROM per)
            WHERE item <> '' GROUP BY doc_id, item)
        SELECT doc_id, coalesce(joined, '') AS items FROM documents LEFT JOIN
            (SELECT doc_id, string_agg(item, '|' ORDER BY pos) AS joined FROM kept GROUP BY doc_id) USING (doc_id)""",
    "unique_clean": "WITH src AS (SELECT doc_id, regexp_split_to_array(text, '[., ]') AS parts FROM documents), "
        + _unique_sql("parts", "doc_id")
        + " SELECT doc_id, coalesce(joined, '') AS items FROM documents LEFT JOIN lists ON doc_id = key",
    "parse_authors": f"""WITH src AS (SELECT doc_id, string_split(regexp_replace({_norm_u('text')}, '\\s+and\\s+', ', ', 'g'), ',')
        AS parts FROM documents), """ + _unique_sql("parts", "doc_id")
        + " SELECT doc_id, coalesce(joined, '') AS authors FROM documents LEFT JOIN lists ON doc_id = key",
    "stable_id": with_sql(TEXT_SQL) + """SELECT id, concat('cvpr-', year, '-',
        substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-',
        substring(sha1(concat(year, ':', title)), 1, 10)) AS stable_id FROM papers_t""",
    "parse_instant": with_sql(EVENTS_SQL) + f"""SELECT seq,
        CASE k % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            ELSE TIMESTAMP '{NOW}' END AS lenient,
        CASE k % 4 WHEN 0 THEN date_trunc('second', ts) ELSE TIMESTAMP '{NOW}' END AS strict FROM ev""",
    "extract_keywords": _KW + "SELECT source_id, term, score, rank FROM keyword_rows",
    "keywords_array": _KW + """SELECT source_id, coalesce(k, '') AS keywords FROM papers_t LEFT JOIN (
        SELECT source_id, string_agg(term, '|' ORDER BY rank) AS k FROM keyword_rows GROUP BY 1) USING (source_id)""",
    "phrase_hits": f"""WITH norm AS (SELECT doc_id, regexp_replace(regexp_replace(lower(concat(text, ' open-vocabulary ', source)),
        '[-_/]+', ' ', 'g'), '[^a-z0-9{WIDE_SPACE}]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, phrase FROM norm JOIN (VALUES {', '.join(f"('{p}')" for p in TEXT_PHRASES)}) AS p(phrase)
        ON contains(n, phrase)""",
    "normalize_papers": "WITH " + TEXT_SQL + f""", base AS (SELECT id, year, {_norm_u('title')} AS title,
            {_norm_u('abstract')} AS abstract, split_part(source_id, '-', 1) AS place, abstract AS whole FROM papers_t),
        src AS (SELECT id, string_split(whole, '.') AS parts FROM base), """ + _unique_sql("parts", "id") + ", "
        + KEYWORDS_SQL.format(source="base", key="id", text="concat(title, ' ', abstract)") + f""",
        kw AS (SELECT source_id AS id, string_agg(term, '|' ORDER BY rank) AS found FROM keyword_rows GROUP BY 1)
        SELECT id, concat('cvpr-', year, '-', substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80),
            '-', substring(sha1(concat(year, ':', title)), 1, 10)) AS source_id, year, title, abstract,
            coalesce(joined, '') AS authors, concat({_norm_u('place')}, '|Library') AS institutions,
            CASE WHEN id % 3 = 0 THEN 'archive|text corpus' ELSE coalesce(found, '') END AS keywords,
            '' AS paper_url, '' AS pdf_url, '{NOW.replace(" ", "T")}Z' AS crawled_at
        FROM base LEFT JOIN lists ON id = key LEFT JOIN kw USING (id)""",
    "to_messages": with_sql(EVENTS_SQL) + """SELECT source_id AS key, concat('{"source_id":"', source_id, '","year":', year,
        ',"event_type":"', event_type, '","position":', seq, '}') AS value FROM ev""",
    "json_file_scan": with_sql(EVENTS_SQL) + "SELECT seq, source_id, year, props FROM ev",
    "emit_new_only": with_sql(EVENTS_SQL) + """, seen AS (SELECT source_id FROM ev WHERE event_type = 'signup' AND year = 2001)
        SELECT source_id, arg_min(year, seq) AS year, min(seq) AS seq, arg_min(event_type, seq) AS event_type FROM ev
        WHERE source_id NOT IN (SELECT source_id FROM seen) GROUP BY 1""",
    "cycle_counts": with_sql(EVENTS_SQL) + """, seen AS (SELECT DISTINCT source_id FROM ev WHERE event_type = 'signup' AND year = 2001),
        fresh AS (SELECT DISTINCT source_id FROM ev WHERE source_id NOT IN (SELECT source_id FROM seen))
        SELECT (SELECT count(*) FROM ev) AS discovered, (SELECT count(*) FROM fresh) AS new,
        (SELECT count(*) FROM seen) + (SELECT count(*) FROM fresh) AS seen""",
}

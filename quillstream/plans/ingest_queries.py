"""Messages to tables: batch operators, the atomic load, the streams and the feed."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quillstream import lexicon
from quillstream.operators import changes, ingest as ops
from quillstream.operators.perkey import insert_absent
from quillstream.operators.ranks import by, nth_keys
from quillstream.operators.stats import ranked_keywords, ranked_values, rebuild_counters
from quillstream.plans.adapters import (CHANGES_SQL, EVENTS, EVENTS_SQL, MESSAGES_SQL, NOW, TEXT_SQL, change_log, change_rows, event_rows,
                                        message_rows, messages, now_column, papers_text, with_sql)
from quillstream.plans.dashboard import dashboard, stored_tables
from quillstream.plans.keyword_sql import STOP_LIST
from quillstream.schemas import LIST_FIELDS, MESSAGE
from quillstream.session import pin_session, shared_dir, stored
from quillstream.sources.change_table import change_stream
from quillstream.sources.files import read_table
from quillstream.sources.messages import file_stream, numbered, text_stream
from quillstream.streaming import cycles, feed, state
from quillstream.streaming.ingest import load_batch, start_ingest
from quillstream.streaming.tables import BatchTables

LOADED_AT = datetime(2026, 1, 1, tzinfo=timezone.utc)
BROKEN_YEAR = 2003
ONCE = {"availableNow": True}


def flat_events(events):
    """Parsed events with lists as joined text, for comparison."""
    return events.select(*[F.concat_ws("|", c).alias(c) if c in LIST_FIELDS else c for c in ("seq", *ops.EVENT_COLUMNS)])


def _parsed(spark, folder):
    return ops.parse_events(messages(spark, folder))


def valid(spark, folder):
    return ops.valid_events(_parsed(spark, folder))


def _parse_events(spark, folder):
    return flat_events(_parsed(spark, folder).where(F.col("reason").isNull()))


def _valid_events(spark, folder):
    return flat_events(valid(spark, folder))


def _quarantine(spark, folder):
    return ops.quarantined(_parsed(spark, folder)).select("seq", "reason")


def _quarantine_props(spark, folder):
    """Raw properties as messages, cut short for errors."""
    e = event_rows(read_table(pin_session(spark), folder, "events"))
    cut = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = ops.parse_events(e.select("seq", cut.alias("value")))
    return parsed.groupBy(F.coalesce("reason", F.lit("parsed")).alias("status")).agg(F.count("*").alias("n"))


def _latest(spark, folder):
    e = event_rows(read_table(pin_session(spark), folder, "events"))
    latest = ops.latest_events(e.select("source_id", "seq", "year", "event_type", "value"))
    return latest.select("source_id", "seq", "year", F.col("event_type").alias("title"), "value")


def _first(spark, folder):
    e = event_rows(read_table(pin_session(spark), folder, "events"))
    return ops.first_events(e.select("source_id", "seq", "year", F.col("event_type").alias("title")))


_PAYLOAD = ["year", "title"]


def _later(events):
    """Whether an event is in the later half of all: from the middle one on, or the upper one of two.

    Located by rank, as an exact median is merged in one task.
    """
    keys = stored(events.select("seq").where(F.col("seq").isNotNull()), "halves")
    middle = nth_keys(keys, [], by("seq"), keys.count() // 2 + 1).first()
    return F.col("seq") >= F.lit(None if middle is None else middle["seq"]).cast("bigint")


def _merge(spark, folder):
    """Later half of the events merged over the state of the first half."""
    e = event_rows(read_table(pin_session(spark), folder, "events")).select("source_id", "seq", "year", F.col("event_type").alias("title"))
    later = _later(e)
    early, late = e.where(~later), e.where(later)
    loaded = F.lit("2025-01-01 00:00:00").cast("timestamp")
    stored = ops.latest_events(early).select(F.col("seq").alias("id"), "source_id", *_PAYLOAD,
                                             loaded.alias("created_at"), loaded.alias("updated_at"))
    batch = ops.latest_events(late).select(F.col("seq").alias("id"), "source_id", *_PAYLOAD)
    merged = ops.upsert_merge(stored, batch, now_column(), _PAYLOAD)
    return merged.select("id", "source_id", *_PAYLOAD, *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])


def _dimension(field):
    return lambda spark, folder: ops.dimension_rows(valid(spark, folder), field)


def _insert_absent(spark, folder):
    """Authors of the first half, plus those the second half adds."""
    rows = valid(spark, folder)
    later = _later(messages(spark, folder))
    first = ops.dimension_rows(rows.where(~later), "authors")
    return insert_absent(first, ops.dimension_rows(rows.where(later), "authors"), ["source_id", "value"])


def _incremental(field):
    def run(spark, folder):
        firsts = ops.first_events(valid(spark, folder).select("source_id", "seq", "year", *LIST_FIELDS))
        return ops.year_deltas(firsts) if field == "yearly" else ops.value_deltas(firsts, field)
    return run


def _incremental_merged(spark, folder):
    """Counters of two batches merged: ids of the first are not counted again."""
    rows = valid(spark, folder).select("source_id", "seq", "year", *LIST_FIELDS)
    one = ops.first_events(rows.where(F.col("seq") % 3 == 0))
    two = ops.first_events(rows.where(F.col("seq") % 3 != 0)).join(one.select("source_id"), "source_id", "left_anti")
    return ops.merge_counters(ops.value_deltas(one, "keywords"), ops.value_deltas(two, "keywords"), "value")


def _spelled(spark, folder):
    """Events whose ids and authors are spelled in several ways, at times two in one list."""
    rows = valid(spark, folder).select("source_id", "seq", "authors")

    def spelling(v):
        v = F.when(F.col("seq") % 3 == 0, F.replace(v, F.lit("a"), F.lit("á"))).otherwise(v)
        return F.when(F.col("seq") % 2 == 0, F.upper(v)).otherwise(F.concat(v, F.lit(" ")))

    both = F.transform("authors", lambda v: F.array(spelling(v), F.when(F.col("seq") % 5 == 0, v)))
    authors = F.array_distinct(F.filter(F.flatten(both), lambda v: v.isNotNull()))
    return rows.select(F.when(F.col("seq") % 2 == 0, F.upper("source_id")).otherwise(F.col("source_id")).alias("source_id"), "seq", authors.alias("authors"))


def _dim_collated(spark, folder):
    """Authors by collation key: those of one batch, then what another one adds."""
    rows = _spelled(spark, folder)
    one, two = (ops.keyed_dimension(rows.where((F.col("seq") % 4 == 0) == first), "authors") for first in (True, False))
    merged = ops.merge_keyed(one, two, ["source_id_key", "value_key"])
    return merged.select("source_id_key", "value_key", "source_id", "value")


def _incremental_collated(spark, folder):
    """Counters by collation key over two batches: ids of the first are not counted again, however they are spelled."""
    rows = _spelled(spark, folder)
    one = ops.first_events_keyed(rows.where(F.col("seq") % 4 == 0))
    two = ops.first_events_keyed(rows.where(F.col("seq") % 4 != 0)).join(one.select("source_id_key"), "source_id_key", "left_anti")
    merged = ops.merge_keyed(ops.keyed_deltas(one, "authors"), ops.keyed_deltas(two, "authors"), ["value_key"])
    return merged.select("value_key", "value", "paper_count")


def _rebuild_from_messages(spark, folder):
    """Counters recomputed after all events: they differ from the incremental ones."""
    rows = valid(spark, folder)
    papers = ops.latest_events(rows.select("source_id", "seq", "year"))
    return rebuild_counters(papers, {})["yearly"]


# Stored tables and streams ---------------------------------------------------

def _counter_rows(tables):
    return tables.all_counters().select("counter", F.col("value").alias("name"), "paper_count")


def _ingest_atomic(spark, folder):
    """Two batches, then the second one replayed and re-sent: counters stay."""
    tables = BatchTables(pin_session(spark), shared_dir(spark, "atomic"))
    rows = messages(spark, folder)
    later = _later(rows)
    late = rows.where(later)
    load_batch(tables, rows.where(~later), "job", 0, LOADED_AT)
    load_batch(tables, late, "job", 1, LOADED_AT)
    load_batch(tables, late, "job", 1, LOADED_AT)
    load_batch(tables, late, "other job", 0, LOADED_AT)
    return _counter_rows(tables)


def _event_stream(spark, folder):
    return file_stream(pin_session(spark), f"{folder}/{{events}}.parquet", schema=EVENTS)


def _run_ingest(spark, folder, runs=1):
    root = shared_dir(spark, "ingest")
    tables = BatchTables(pin_session(spark), f"{root}/tables")
    for run in range(runs):
        stream = message_rows(_event_stream(spark, folder))
        start_ingest(stream, tables, f"{root}/checkpoint-{run}", ONCE, lambda _: LOADED_AT).awaitTermination()
    return tables


def _stream_ingest(spark, folder):
    papers = _run_ingest(spark, folder).papers()
    stamps = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("crawled_at", "created_at", "updated_at")]
    return papers.select("id", "source_id", "year", "title", "abstract", "paper_url", "pdf_url", *stamps)


def _stream_dims(spark, folder):
    tables = _run_ingest(spark, folder)
    rows = [tables.dimension(f).select(F.lit(f).alias("dimension"), "source_id", "value") for f in LIST_FIELDS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _stream_replay(spark, folder):
    return _counter_rows(_run_ingest(spark, folder, runs=2))


def _stream_folded(spark, folder):
    """Counters after the batches were folded into a fresh root."""
    return _counter_rows(_run_ingest(spark, folder).fold_into(shared_dir(spark, "folded")))


def _stream_source(spark, folder):
    """Messages as they pass through a stream, appended as they come."""
    root = shared_dir(spark, "source")
    stream = message_rows(_event_stream(spark, folder))
    query, tables = state.start_upserts(stream, spark, f"{root}/tables", f"{root}/checkpoint")
    query.awaitTermination()
    return tables.read("state").select("seq", F.col("value").endswith("}").alias("complete"))


def _stream_text(spark, folder):
    """Lines of text files, numbered as they come: in the order of each file's lines."""
    root = shared_dir(spark, "text")
    ids = read_table(pin_session(spark), folder, "events").select(F.col("event_id").alias("id"))
    ids.repartition(3, F.col("id") % 3).sortWithinPartitions("id").select(F.col("id").cast("string").alias("value")).write.text(f"{root}/in")
    query, tables = state.start_upserts(text_stream(spark, f"{root}/in", max_files=2), spark, f"{root}/tables", f"{root}/checkpoint", prepare=numbered, schema=MESSAGE)
    query.awaitTermination()
    rows = tables.read("state").select("seq", F.col("value").cast("bigint").alias("event_id"))
    # files are read apart by what they hold; a task may have written several groups into one
    line = F.row_number().over(Window.partitionBy(F.col("event_id") % 3).orderBy("seq")) - 1
    return rows.select("event_id", line.alias("line"), (F.count("*").over(Window.partitionBy("seq")) == 1).alias("alone"))


def _finish(spark, root, changes_stream, **reduced):
    query, tables = state.start_upserts(changes_stream, spark, f"{root}/tables", f"{root}/checkpoint", **reduced)
    query.awaitTermination()
    return tables


def _stream_first_seen(spark, folder):
    seen = state.first_seen(event_rows(_event_stream(spark, folder)).select("source_id", "seq"))
    return state.current_state(_finish(spark, shared_dir(spark, "seen"), seen), ["source_id"])


def _listed(e):
    """Ids that many events share, with one list each."""
    return e.select(F.concat("event_type", F.lit("-"), "k").alias("source_id"), F.array("event_type", F.concat(F.lit("k"), F.col("k") % 20)).alias("values"))


def _stream_counts(spark, folder):
    """Records per listed value: an id counts once, however many events repeat it."""
    counts = state.running_counts(_listed(event_rows(_event_stream(spark, folder))), "values")
    return state.current_state(_finish(spark, shared_dir(spark, "counts"), counts), ["value"])


def _stream_counts_folded(spark, folder):
    """The same after the versions were folded into a fresh root."""
    e = event_rows(_event_stream(spark, folder))
    counts = state.running_counts(_listed(e), "values")
    folded = state.fold_state(_finish(spark, shared_dir(spark, "counts"), counts), shared_dir(spark, "counts-folded"), ["value"])
    return state.current_state(folded, ["value"])


def _stream_upsert(spark, folder):
    e = event_rows(_event_stream(spark, folder)).select("source_id", "seq", "year", F.col("event_type").alias("title"))
    tables = _finish(spark, shared_dir(spark, "upsert"), e, keys=["source_id"], order=["seq"])
    return state.current_state(tables, ["source_id"], ["seq"])


# Rankings over stored counters ---------------------------------------------------

def _stored(spark, folder):
    tables = BatchTables(pin_session(spark), shared_dir(spark, "stored"))
    load_batch(tables, messages(spark, folder), "job", 0, LOADED_AT)
    return stored_tables(tables)


def _summary_sketched(spark, folder):
    """Totals over stored tables of two batches from sketches and counters."""
    tables = BatchTables(pin_session(spark), shared_dir(spark, "sketched"))
    rows = messages(spark, folder)
    for batch in range(2):
        load_batch(tables, rows.where(F.col("seq") % 2 == batch), "job", batch, LOADED_AT)
    return tables.summary()


def _cycle_counts_by_year(spark, folder):
    """Papers of each year, loaded year by year; one year breaks and takes no other along."""
    papers = event_rows(read_table(pin_session(spark), folder, "events")).select("seq", "source_id", "year")

    def load(year):
        rows = papers.where(F.col("year") == year)
        return rows.withColumn("source_id", F.raise_error(F.lit("no such page")).cast("string")) if year == BROKEN_YEAR else rows

    found, outcome = cycles.crawl_years(spark, list(range(2000, 2007)), load)
    watched, counts = cycles.observe_years(found)
    watched.write.format("noop").mode("overwrite").save()
    seen = spark.createDataFrame(list(cycles.per_year(counts.get).items()), "seen_year int, papers_seen bigint")
    return outcome.join(seen, F.col("year") == F.col("seen_year"), "left").select(
        "year", "papers", F.coalesce("papers_seen", F.lit(0)).cast("bigint").alias("papers_seen"), F.col("error").isNotNull().alias("failed"))


def _watch_cycle(spark, folder):
    """Two cycles: in the first some records can't be sent, the second sends them with what is new."""
    e = event_rows(read_table(pin_session(spark), folder, "events"))
    found = e.select("source_id", F.col("event_type").alias("value"), "seq")
    outbox = cycles.Outbox(spark, shared_dir(spark, "outbox"))
    ok = F.substr("source_id", F.lit(2)).cast("bigint") % 5 != 0
    outbox.cycle(found.where(F.col("seq") % 2 == 0), lambda due: due.select("source_id", ok.alias("ok")), ["seq"])
    outbox.cycle(found, lambda due: None, ["seq"])
    tries = outbox.tables.read("outbox").groupBy("source_id").agg(F.count("*").alias("tries"))
    return outbox.states().join(tries, "source_id").select("source_id", "value", "state", "cycle", "tries")


def _ranked(field):
    def run(spark, folder):
        stored = _stored(spark, folder)
        rank = ranked_keywords if field == "keywords" else ranked_values
        return rank(stored[f"stats_{field}"], stored[field], probe=True)
    return run


def _board(part):
    return lambda spark, folder: dashboard(_stored(spark, folder))[part]


# Change feed -------------------------------------------------------------------

def _change_feed(spark, folder):
    rows = changes.change_rows(change_log(spark, folder), "library", "papers")
    out = changes.project_images(rows, now_column())
    stamps = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    return out.select("seq", "id", "source_id", "year", "title", "abstract", "paper_url", "pdf_url", *stamps)


def _change_events(spark, folder):
    log = change_log(spark, folder)
    rows = feed.log_events(log, "library", "papers", now_column())
    return rows.select("seq", "event")


def _stream_changes(spark, folder):
    """The same notifications from the change log as a stream."""
    log = change_rows(_event_stream(spark, folder))
    return _finish(spark, shared_dir(spark, "changes"), feed.log_events(log, "library", "papers", now_column())).read("state").select("seq", "event")


def _timed(spark, folder):
    docs = papers_text(spark, folder)
    updated = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1) * cast(floor(id / 7) as int)")
    return docs.select("id", "source_id", "year", "title", updated.alias("updated_at"))


_AFTER = "2024-01-01 00:00:40"


def _after():
    return F.lit(_AFTER).cast("timestamp_ntz")


def _updated_after(spark, folder):
    return changes.updated_after(_timed(spark, folder), _after())


def _updated_after_pair(spark, folder):
    return changes.updated_after(_timed(spark, folder), _after(), F.lit(282))


def _poll_cursor(spark, folder):
    return changes.poll_cursor(_updated_after_pair(spark, folder), _after(), F.lit(282).cast("bigint"))


def _watch_changes(spark, folder):
    """A watcher whose log fails: it polls, is started again when the table has more, and sends every change once."""
    papers = papers_text(spark, folder).select((F.col("id") % 3).alias("id"), "source_id", "year",
                                               F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1) * cast(floor(id / 50) as int)").alias("updated_at"))
    root = shared_dir(spark, "watch")
    half = papers.agg(F.timestamp_micros(F.percentile_approx(F.unix_micros("updated_at"), 0.5))).scalar()
    watcher = feed.ChangeWatcher(pin_session(spark), f"{root}/watcher")
    for part, rows in enumerate((papers.where(F.col("updated_at") <= half), papers.where(F.col("updated_at") > half))):
        rows.write.parquet(f"{root}/table/part={part}")
        watcher.run(lambda: file_stream(spark, f"{root}/no log", schema=papers.schema), lambda: change_stream(spark, f"{root}/table", papers.schema, datetime(2020, 1, 1)), ONCE)
    return watcher.events().select("via", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "id", "source_id", "event")


def _poll_walk(spark, folder):
    """All polls over changes of which more than a poll pulls share time and id."""
    papers = papers_text(spark, folder).select((F.col("id") % 3).alias("id"), "source_id", F.lit(datetime(2024, 1, 1, 12)).alias("updated_at"))
    limit, cursor, polls = -(-papers.count() // 9), (datetime(2024, 1, 1), -1), []
    while True:
        events, after = feed.poll(papers, cursor, limit)
        polls.append(events.select(F.lit(len(polls)).alias("poll"), F.get_json_object("event", "$.payload.id").cast("bigint").alias("id"),
                                   F.get_json_object("event", "$.payload.source_id").alias("source_id")))
        if after == cursor:
            return reduce(DataFrame.unionByName, polls)
        cursor = after


QUERIES = {
    "parse_events": _parse_events,
    "valid_events": _valid_events,
    "quarantine_split": _quarantine,
    "quarantine_props": _quarantine_props,
    "first_seen": _first,
    "upsert_latest": _latest,
    "upsert_merge": _merge,
    "dim_authors_messages": _dimension("authors"),
    "dim_institutions_messages": _dimension("institutions"),
    "dim_keywords_messages": _dimension("keywords"),
    "dim_insert_absent": _insert_absent,
    "stats_incremental_yearly": _incremental("yearly"),
    "stats_incremental_authors": _incremental("authors"),
    "stats_incremental_institutions": _incremental("institutions"),
    "stats_incremental_keywords": _incremental("keywords"),
    "stats_incremental_merged": _incremental_merged,
    "dim_authors_collated": _dim_collated,
    "stats_incremental_collated": _incremental_collated,
    "summary_sketched": _summary_sketched,
    "cycle_counts_by_year": _cycle_counts_by_year,
    "watch_cycle": _watch_cycle,
    "rebuild_yearly_messages": _rebuild_from_messages,
    "ingest_atomic": _ingest_atomic,
    "stream_source": _stream_source,
    "stream_text": _stream_text,
    "stream_ingest": _stream_ingest,
    "stream_dimensions": _stream_dims,
    "stream_replay": _stream_replay,
    "stream_folded": _stream_folded,
    "stream_first_seen": _stream_first_seen,
    "stream_counts": _stream_counts,
    "stream_counts_folded": _stream_counts_folded,
    "stream_upsert": _stream_upsert,
    "ranked_keywords": _ranked("keywords"),
    "ranked_authors": _ranked("authors"),
    "ranked_institutions": _ranked("institutions"),
    "dashboard_yearly": _board("yearly"),
    "dashboard_authors": _board("authors"),
    "change_feed": _change_feed,
    "change_events": _change_events,
    "stream_changes": _stream_changes,
    "updated_after": _updated_after,
    "updated_after_pair": _updated_after_pair,
    "poll_cursor": _poll_cursor,
    "poll_walk": _poll_walk,
    "watch_changes": _watch_changes,
}

_M = with_sql(MESSAGES_SQL)
_E = with_sql(EVENTS_SQL)
_EVENT_SELECT = """SELECT seq, source_id, year, title, authors, institutions, abstract, keywords, paper_url, pdf_url,
    strftime(crawled_at, '%Y-%m-%dT%H:%M:%SZ') AS crawled_at FROM """
_FIRSTS = """, firsts AS (SELECT source_id, min(seq) AS seq, arg_min(year, seq) AS year, arg_min(authors, seq) AS authors,
    arg_min(institutions, seq) AS institutions, arg_min(keywords, seq) AS keywords FROM good GROUP BY 1)"""


def _delta_sql(field):
    return _M + _FIRSTS + f"""SELECT value, count(*) AS paper_count FROM (
        SELECT unnest(string_split({field}, '|')) AS value FROM firsts) GROUP BY 1"""


def _ranked_sql(field, limit):
    return f"SELECT value AS name, paper_count AS value FROM ({_delta_sql(field)}) ORDER BY 2 DESC, 1 LIMIT {limit}"


def _dim_sql(field, source="good"):
    return f"SELECT DISTINCT source_id, unnest(string_split({field}, '|')) AS value FROM {source}"


_SPELLED = _M + """, lists AS (SELECT CASE WHEN seq % 2 = 0 THEN upper(source_id) ELSE source_id END AS source_id, seq, unnest(string_split(authors, '|')) AS v FROM good),
    spelled AS (SELECT *, CASE WHEN seq % 3 = 0 THEN replace(v, 'a', 'á') ELSE v END AS w FROM lists),
    listed AS (SELECT DISTINCT source_id, seq, value FROM (
        SELECT source_id, seq, CASE WHEN seq % 2 = 0 THEN upper(w) ELSE w || ' ' END AS value FROM spelled
        UNION ALL SELECT source_id, seq, v FROM spelled WHERE seq % 5 = 0)),
    keyed AS (SELECT *, lower(source_id) AS source_id_key, strip_accents(lower(rtrim(value))) AS value_key,
        CASE WHEN seq % 5 = 0 AND value = strip_accents(lower(value)) AND value = rtrim(value) THEN 1 ELSE 0 END AS pos FROM listed)"""

_ALL_COUNTERS = _M + _FIRSTS + " UNION ALL ".join(
    ["SELECT 'yearly' AS counter, CAST(year AS VARCHAR) AS name, count(*) AS paper_count FROM firsts GROUP BY 2"]
    + [f"""SELECT '{f}' AS counter, value AS name, count(*) AS paper_count FROM (
        SELECT unnest(string_split({f}, '|')) AS value FROM firsts) GROUP BY 2""" for f in LIST_FIELDS])

_TIMED = "WITH " + TEXT_SQL + """, timed AS (SELECT id, source_id, year, title,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST(floor(id / 7) AS INT) AS updated_at FROM papers_t) """
_PAIR = f"""SELECT * FROM timed WHERE (updated_at > TIMESTAMP '{_AFTER}') OR (updated_at = TIMESTAMP '{_AFTER}' AND id > 282)
    ORDER BY updated_at, id LIMIT 50"""

_POLLS = "WITH " + TEXT_SQL + """ SELECT CAST(floor((row_number() OVER (ORDER BY id % 3, source_id) - 1) / ceil((SELECT count(*) FROM papers_t) / 9.0)) AS INT) AS poll,
    id % 3 AS id, source_id FROM papers_t"""

_CHANGE_EVENTS = "WITH " + CHANGES_SQL + """SELECT seq, concat('{"type":"paper.updated","payload":{"id":', id, ',"source_id":"', source_id,
        '","year":', year, ',"title":"', title, '","abstract":"', replace(abstract, '"', '\\"'), '","paper_url":"', paper_url,
        '","pdf_url":"","created_at":"', strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z'), '","updated_at":"',
        strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z'), '"}}') AS event FROM changed"""

_COUNTS = _E + """, ids AS (SELECT DISTINCT event_type, k FROM ev) SELECT value, count(*) AS paper_count FROM (SELECT event_type AS value FROM ids
        UNION ALL SELECT concat('k', k % 20) FROM ids) GROUP BY 1"""

ORACLE = {
    "parse_events": _M + _EVENT_SELECT + "parsed",
    "valid_events": _M + _EVENT_SELECT + "good",
    "quarantine_split": _E + "SELECT seq, 'malformed' AS reason FROM ev WHERE k % 23 = 5",
    "quarantine_props": _E + "SELECT CASE WHEN event_type = 'error' THEN 'malformed' ELSE 'parsed' END AS status, count(*) AS n FROM ev GROUP BY 1",
    "first_seen": _E + "SELECT source_id, min(seq) AS seq, arg_min(year, seq) AS year, arg_min(event_type, seq) AS title FROM ev GROUP BY 1",
    "upsert_latest": _E + """SELECT source_id, max(seq) AS seq, arg_max(year, seq) AS year, arg_max(event_type, seq) AS title,
        arg_max(value, seq) AS value FROM ev GROUP BY 1""",
    "upsert_merge": _E + f""", stored AS (SELECT source_id, max(seq) AS id, arg_max(year, seq) AS year, arg_max(event_type, seq) AS title
            FROM ev WHERE seq < (SELECT median(seq) FROM ev) GROUP BY 1),
        batch AS (SELECT source_id, max(seq) AS id, arg_max(year, seq) AS year, arg_max(event_type, seq) AS title
            FROM ev WHERE seq >= (SELECT median(seq) FROM ev) GROUP BY 1)
        SELECT coalesce(s.id, b.id) AS id, source_id, coalesce(b.year, s.year) AS year, coalesce(b.title, s.title) AS title,
            CASE WHEN s.id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2025-01-01' END AS created_at,
            CASE WHEN b.id IS NOT NULL AND (s.id IS NULL OR s.year <> b.year OR s.title <> b.title) THEN TIMESTAMP '{NOW}'
                ELSE TIMESTAMP '2025-01-01' END AS updated_at
        FROM stored s FULL JOIN batch b USING (source_id)""",
    "dim_authors_messages": _M + _dim_sql("authors"),
    "dim_institutions_messages": _M + _dim_sql("institutions"),
    "dim_keywords_messages": _M + _dim_sql("keywords"),
    "dim_insert_absent": _M + _dim_sql("authors"),
    "stats_incremental_yearly": _M + _FIRSTS + "SELECT year, count(*) AS paper_count FROM firsts GROUP BY 1",
    "stats_incremental_authors": _delta_sql("authors"),
    "stats_incremental_institutions": _delta_sql("institutions"),
    "stats_incremental_keywords": _delta_sql("keywords"),
    "dim_authors_collated": _SPELLED + """SELECT source_id_key, value_key, arg_min(source_id, seq) AS source_id, arg_min(value, (seq, pos)) AS value FROM keyed GROUP BY ALL""",
    "stats_incremental_collated": _SPELLED + """, firsts AS (SELECT source_id_key, coalesce(min(seq) FILTER (seq % 4 = 0), min(seq)) AS seq FROM keyed GROUP BY 1)
        SELECT value_key, arg_min(value, (seq, source_pos)) AS value, count(*) AS paper_count FROM (
            SELECT k.value_key, k.value, k.seq, k.pos AS source_pos FROM keyed k JOIN firsts f ON k.source_id_key = f.source_id_key AND k.seq = f.seq) GROUP BY 1""",
    "summary_sketched": _M + f"""SELECT (SELECT count(DISTINCT source_id) FROM good)::BIGINT AS papers, (SELECT count(DISTINCT year) FROM (
            SELECT arg_min(year, seq) AS year FROM good WHERE seq % 2 = 0 GROUP BY source_id UNION ALL SELECT arg_min(year, seq) FROM good WHERE seq % 2 = 1 GROUP BY source_id)) AS years,
        (SELECT count(DISTINCT v) FROM (SELECT unnest(string_split(keywords, '|')) AS v FROM good) WHERE lower(v) NOT IN ({STOP_LIST})) AS keywords,
        (SELECT count(DISTINCT v) FROM (SELECT unnest(string_split(authors, '|')) AS v FROM good)) AS authors,
        (SELECT count(DISTINCT institutions) FROM good) AS institutions""",
    "cycle_counts_by_year": _E + f"""SELECT CAST(y.year AS INT) AS year, CASE WHEN y.year = {BROKEN_YEAR} THEN 0 ELSE count(ev.seq) END AS papers,
        CASE WHEN y.year = {BROKEN_YEAR} THEN 0 ELSE count(ev.seq) END AS papers_seen, y.year = {BROKEN_YEAR} AS failed
        FROM (SELECT unnest(range(2000, 2007)) AS year) y LEFT JOIN ev USING (year) GROUP BY y.year""",
    "watch_cycle": _E + """, one AS (SELECT source_id, min(user_id) AS user_id, arg_min(event_type, seq) AS value FROM ev WHERE seq % 2 = 0 GROUP BY 1),
        two AS (SELECT source_id, arg_min(event_type, seq) AS value FROM ev GROUP BY 1)
        SELECT source_id, coalesce(one.value, two.value) AS value, 'emitted' AS state, CAST(CASE WHEN one.source_id IS NULL OR user_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS cycle,
            CAST(CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS tries FROM two LEFT JOIN one USING (source_id)""",
    "stats_incremental_merged": _M + """, one AS (SELECT source_id, arg_min(keywords, seq) AS keywords FROM good WHERE seq % 3 = 0 GROUP BY 1),
        two AS (SELECT source_id, arg_min(keywords, seq) AS keywords FROM good WHERE seq % 3 <> 0
            AND source_id NOT IN (SELECT source_id FROM one) GROUP BY 1)
        SELECT value, count(*) AS paper_count FROM (SELECT unnest(string_split(keywords, '|')) AS value FROM
            (SELECT * FROM one UNION ALL SELECT * FROM two)) GROUP BY 1""",
    "rebuild_yearly_messages": _M + """SELECT year, count(*) AS paper_count FROM
        (SELECT source_id, arg_max(year, seq) AS year FROM good GROUP BY 1) GROUP BY 1""",
    "ingest_atomic": _ALL_COUNTERS,
    "stream_replay": _ALL_COUNTERS,
    "stream_folded": _ALL_COUNTERS,
    "stream_source": _E + "SELECT seq, k % 23 <> 5 AS complete FROM ev",
    "stream_text": "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS INT) AS line, true AS alone FROM events",
    "stream_ingest": _M + f"""SELECT source_id, min(seq) AS id, arg_max(year, seq) AS year, arg_max(title, seq) AS title,
        arg_max(abstract, seq) AS abstract, arg_max(paper_url, seq) AS paper_url, '' AS pdf_url, arg_max(crawled_at, seq) AS crawled_at,
        TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at FROM good GROUP BY 1""",
    "stream_dimensions": _M + " UNION ALL ".join(
        f"SELECT '{f}' AS dimension, * FROM ({_dim_sql(f)})" for f in LIST_FIELDS),
    "stream_first_seen": _E + "SELECT source_id, min(seq) AS first_seq FROM ev GROUP BY 1",
    "stream_counts": _COUNTS,
    "stream_counts_folded": _COUNTS,
    "ranked_keywords": f"""SELECT * FROM (SELECT value AS name, paper_count AS value FROM ({_delta_sql("keywords")})
        ORDER BY 2 DESC, 1 LIMIT {lexicon.KEYWORD_LIMIT * lexicon.OVERFETCH}) WHERE lower(name) NOT IN ({STOP_LIST})
        ORDER BY 2 DESC, 1 LIMIT {lexicon.KEYWORD_LIMIT}""",
    "ranked_authors": _ranked_sql("authors", lexicon.RANKING_LIMIT),
    "ranked_institutions": _ranked_sql("institutions", lexicon.RANKING_LIMIT),
    "dashboard_yearly": _M + _FIRSTS + "SELECT year, count(*) AS count FROM firsts GROUP BY 1",
    "dashboard_authors": _ranked_sql("authors", lexicon.DASHBOARD_RANKING_LIMIT),
    "stream_upsert": _E + """SELECT source_id, max(seq) AS seq, arg_max(year, seq) AS year, arg_max(event_type, seq) AS title
        FROM ev GROUP BY 1""",
    "change_feed": "WITH " + CHANGES_SQL + """SELECT seq, id, source_id, year, title, abstract, paper_url, pdf_url, created_at, updated_at
        FROM changed""",
    "change_events": _CHANGE_EVENTS,
    "stream_changes": _CHANGE_EVENTS,
    "updated_after": _TIMED + f"SELECT * FROM timed WHERE updated_at > TIMESTAMP '{_AFTER}' ORDER BY updated_at, id LIMIT 50",
    "updated_after_pair": _TIMED + _PAIR,
    "poll_cursor": _TIMED + f"""SELECT coalesce(max(updated_at), TIMESTAMP '{_AFTER}') AS updated_at,
        coalesce(arg_max(id, (updated_at, id)), 282) AS id FROM ({_PAIR})""",
    "poll_walk": _POLLS,
    "watch_changes": "WITH " + TEXT_SQL + """ SELECT 'poll' AS via, updated_at, id, source_id, concat('{"type":"paper.updated","payload":{"id":', id,
        ',"source_id":"', source_id, '","year":', year, ',"updated_at":"', strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z'), '"}}') AS event
        FROM (SELECT id % 3 AS id, source_id, year, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST(floor(id / 50) AS INT) AS updated_at FROM papers_t)""",
}

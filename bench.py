"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
input and the cores. Every query is run once to warm up and once timed, to the
last row, into a sink that discards it.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillstream.plans.registry import QUERIES  # noqa: E402
from quillstream.session import build_session  # noqa: E402

HEADLINE = [
    "yearly", "count_by_author", "count_by_keyword", "top_authors", "top_keywords", "summary", "dashboard_kpis",
    "rebuild_authors", "search_text", "search_page", "page_meta", "normalize_text", "stable_id", "extract_keywords",
    "normalize_papers", "clean_html", "listing_papers", "detail_fields", "enrich_details", "limit_per_year_large",
    "crawl_order", "parse_events", "first_seen", "upsert_latest", "upsert_merge", "stats_incremental_keywords",
    "emit_new_only", "change_feed", "updated_after", "stream_ingest", "stream_counts",
]


def run(spark, name, folder):
    start = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    messages = spark.read.parquet(f"{folder}/events.parquet").count()
    line = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if "stream_ingest" in times:
        line["ingest_records_per_sec"] = round(messages / times["stream_ingest"])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

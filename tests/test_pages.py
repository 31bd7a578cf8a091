"""Listing and detail extraction, enrichment and normalisation."""

from pyspark.sql import functions as F

from quillstream import lexicon
from quillstream.operators import pages as ops, records
from quillstream.sources.demo import sample_papers



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


BASE = "https://site.example.org/YEAR2024?day=all"

# The golden listing and detail pages.
LISTING = """<html><body><dl>
<dt class="ptitle"><br><a href="content/html/example.html">Open-Vocabulary  Scene Understanding</a></dt>
<dd>Alice Zhang, Bob Wang</dd>
<dd><a href="content/papers/example.pdf">pdf</a> <a href="x.bib">bib</a></dd>
<dt class='big ptitle x'><a href="/content/html/two.html">Deep &amp; <i>Wide</i> Nets</a></dt>
<dd><form><input type="hidden" name="query_author" value="Zo&eacute; K"><a href="#">Zo&eacute; K</a> and Bob Wang</form></dd>
<dd><a href="../papers/two">PDF</a></dd>
<dt class="ptitle"><a href="/content/html/empty.html"> </a></dt>
<dd>Nobody</dd>
<dt class="ptitle"><a href="/content/html/three.html">No Paper File</a></dt>
</dl></body></html>"""

DETAIL = """<html><body><div id="abstract">Abstract We present a vision-language foundation model for object detection.</div>
<a href="home.html">home</a><a href="../papers/example-detail.pdf">pdf</a></body></html>"""


def listing(spark, **layout):
    pages = spark.createDataFrame([(1, 2024, BASE, LISTING)], "page_id int, year int, url string, html string")
    return ops.listing_papers(pages, ops.ListingLayout(**layout)).orderBy("pos")


def test_listing(spark):
    rows = listing(spark).collect()
    assert [r["title"] for r in rows] == ["Open-Vocabulary Scene Understanding", "Deep & Wide Nets", "No Paper File"]
    assert rows[0]["authors"] == ["Alice Zhang", "Bob Wang"]
    assert rows[1]["authors"] == ["Zoé K", "Bob Wang"]
    assert rows[0]["paper_url"] == "https://site.example.org/content/html/example.html"
    assert [r["pdf_url"] for r in rows] == [
        "https://site.example.org/content/papers/example.pdf", "https://site.example.org/papers/two", ""]
    assert [r["year"] for r in rows] == [2024] * 3


def test_listing_other_rules(spark):
    rows = listing(spark, authors=lexicon.AUTHOR_INPUT, author_rule="values", pdf_rule="suffix").collect()
    assert rows[1]["authors"] == ["Zoé K"] and rows[0]["authors"] == []
    assert [r["pdf_url"] for r in rows] == ["https://site.example.org/content/papers/example.pdf", "", ""]


def test_listing_to_records(spark):
    row = records.normalize_papers(listing(spark), now()).where("title like 'Open%'").head()
    assert row["source_id"] == "cvpr-2024-open-vocabulary-scene-understanding-bbc8690b8b"
    assert row["keywords"] == ["open vocabulary", "scene understanding", "open", "scene", "understanding", "vocabulary"]
    assert row["crawled_at"] == "2026-01-01T00:00:00Z"


def test_detail(spark):
    url = "https://site.example.org/content/html/example.html"
    pages = spark.createDataFrame([(url, DETAIL), ("u2", "<p>none</p>")], "url string, html string")
    rows = {r["paper_url"]: r for r in ops.detail_fields(pages).collect()}
    assert rows[url]["abstract"] == "We present a vision-language foundation model for object detection."
    assert rows[url]["pdf_url"] == "https://site.example.org/content/papers/example-detail.pdf"
    assert (rows["u2"]["abstract"], rows["u2"]["pdf_url"]) == ("", "")


def test_nested_elements_come_out_whole(spark):
    made = {
        "nested": '<div id="abstract"><div>one</div> two</div> three',
        "deep": '<DIV class="x" id="abstract">Abstract <div><div>a</div></div><divider>b</divider><div/> c<br></Div><div>d</div>',
        "other": '<section><p id="abstract">p <b>q</b></p><p>r</p></section>',
        "open": '<div id="abstract">never <div>closed</div> at all',
        "first": '<div id="abstract"></div><div id="abstract">second</div>',
        "none": "<div>no</div>", "empty": "", "null": None,
    }
    pages = spark.createDataFrame(list(made.items()), "url string, html string")
    got = {r["paper_url"]: r["abstract"] for r in ops.detail_fields(pages).collect()}
    assert got == {"nested": "one two", "deep": "a b c", "other": "p q", "open": "never closed at all", "first": "", "none": "", "empty": "", "null": ""}
    flat = ops.DetailLayout(abstract=lexicon.ABSTRACT_ELEMENT, group=2)
    got = {r["paper_url"]: r["abstract"] for r in ops.detail_fields(pages, flat).collect()}
    assert got["nested"] == "one"


def test_hot_url_is_dealt_out(spark):
    n = 4000
    rows = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("paper_url"), F.lit("Nets").alias("title"),
        F.lit("old").alias("abstract"), F.lit("").alias("pdf_url"), F.array(F.lit("k")).alias("keywords"))
    details = spark.range(1, n, 4).select(F.concat(F.lit("u"), F.col("id")).alias("paper_url"), F.lit("deep").alias("abstract"), F.lit("d.pdf").alias("pdf_url"))
    details = details.unionByName(spark.createDataFrame([("hot", "warm", "h.pdf")], details.schema))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        # a join that nothing but the salt can even out
        for k, v in zip(before, ("-1", "false", "16")):
            spark.conf.set(k, v)
        out = records.enrich_details(rows, details).withColumn("task", F.spark_partition_id()).persist()
        tasks = [r["n"] for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
        got = {r["id"]: r["abstract"] for r in out.collect()}
        out.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(tasks) < 2 * n / 16
    assert got == {i: "warm" if i % 2 == 0 else "deep" if i % 4 == 1 else "old" for i in range(n)}


def test_enrich(spark):
    rows = spark.createDataFrame(
        [(1, "u1", "Nets", "old", "", ["k"]), (2, "u1", "Twins", "old", "mine.pdf", ["k"]), (3, "u9", "Lost", "old", "", ["k"]),
         (4, "", "Bare", "old", "", ["k"]), (5, None, "Null", "old", "", ["k"])],
        "id int, paper_url string, title string, abstract string, pdf_url string, keywords array<string>")
    details = spark.createDataFrame([("u1", "object detection", "d.pdf"), ("u1", "object detection", "d.pdf"), ("", "bad", "bad")],
                                    "paper_url string, abstract string, pdf_url string")
    got = {r["id"]: r for r in records.enrich_details(rows, details).collect()}
    assert len(got) == 5
    assert (got[1]["abstract"], got[1]["pdf_url"]) == ("object detection", "d.pdf")
    assert got[1]["keywords"] == ["object detection", "detection", "nets", "object"]
    assert got[2]["pdf_url"] == "mine.pdf"
    for i in (3, 4, 5):
        assert (got[i]["abstract"], got[i]["keywords"]) == ("old", ["k"])


def test_normalize_papers(spark):
    raw = spark.createDataFrame(
        [("", "2024", " Vision-Language  Object Detection", "A foundation model for open vocabulary object detection.",
          ["Alice Zhang", "Alice Zhang"], [], None),
         ("given", "2023", "T", None, None, None, ["Deep", "deep ", "X"])],
        "source_id string, year string, title string, abstract string, authors array<string>, institutions array<string>, keywords array<string>")
    a, b = sorted(records.normalize_papers(raw, now()).collect(), key=lambda r: r["source_id"])
    assert a["authors"] == ["Alice Zhang"] and a["keywords"][:2] == ["foundation model", "object detection"]
    assert a["source_id"].startswith("cvpr-2024-vision-language-object-detection-")
    assert (b["source_id"], b["keywords"], b["abstract"], b["pdf_url"]) == ("given", ["deep", "x"], "", "")


def test_sample_records(spark):
    rows = sample_papers(spark, now()).orderBy(F.desc("year")).collect()
    assert [r["year"] for r in rows] == [2024, 2023]
    assert rows[1]["keywords"] == ["video", "representation learning", "prompt learning"]
    assert rows[0]["source_id"].startswith("cvpr-2024-vision-foundation-models-for-open-vocabulary-scene-understanding-")


def test_emit_and_cycles(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "source_id string, pos int")
    seen = spark.createDataFrame([("b",), ("b",)], "source_id string")
    assert sorted(records.emit_new_only(batch, seen, ["pos"]).collect()) == [("a", 1), ("c", 4)]
    assert records.cycle_counts(batch, seen).head() == (4, 2, 3)
    watched, seen_counts = records.observe_cycle(batch.withColumn("year", F.col("pos") + 2000))
    watched.count()
    assert seen_counts.get == {"processed": 4, "first_year": 2001, "last_year": 2004}


def test_limit_per_year_zero_keeps_all(spark):
    df = spark.createDataFrame([(2020, i) for i in range(5)], "year int, pos int")
    assert records.limit_per_year(df, 0, ["pos"]).count() == 5
    assert sorted(r["pos"] for r in records.limit_per_year(df, 2, ["pos"]).collect()) == [0, 1]


def test_escaped_links(spark):
    from quillstream.functions.markup import resolve_url, unescape
    refs = ["/a?x=1&amp;y=2", "&#47;b", "../c&ndash;d", "", "&amp;lt;", "https://o.example.org/&eacute;", "//h/p&quot;", "&bogus", "e&#46;&#46;/f", None]
    rows = spark.createDataFrame([("http://h.example.org/x/y", r) for r in refs], "url string, ref string")
    got = rows.select("ref", resolve_url(F.col("url"), F.col("ref"), escaped=True).alias("a"), resolve_url(F.col("url"), unescape(F.col("ref"))).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == "http://h.example.org/a?x=1&y=2" and got[1]["a"] == "http://h.example.org/b"

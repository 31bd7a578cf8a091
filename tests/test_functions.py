"""Golden values and traps of the column functions."""

import html
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quillstream import lexicon
from quillstream.functions import keywords, markup, text

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def one(spark, column, *values):
    """Apply ``column`` to each value; values become column ``v``."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_normalize_rules_differ_on_unicode_space(spark):
    values = ["  a \t\n b ", " x y ", "a\x1cb", None, "\x00\x1fz\x00"]
    assert one(spark, text.normalize_text(F.col("v")), *values) == ["a b", " x y", "a\x1cb", "", "z"]
    assert one(spark, text.normalize_text_u(F.col("v")), *values[:4]) == ["a b", "x y", "a b", ""]


def test_normalize_u_equals_python_split(spark):
    chars = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　é"
    rng = random.Random(1)
    values = ["".join(rng.choice(chars) for _ in range(20)) for _ in range(200)]
    assert one(spark, text.normalize_text_u(F.col("v")), *values) == [" ".join(v.split()) for v in values]


def test_blank(spark):
    assert one(spark, text.is_blank(F.col("v")), "", " \t", " ", " ", "a", None) == [True, True, True, False, False, True]


def test_lists(spark):
    df = spark.createDataFrame([(["Deep", " deep", "Deep ", "", None, " ", "X  y"],)], "a array<string>")
    row = df.select(text.clean_list(F.col("a")).alias("c"), text.unique_clean(F.col("a")).alias("u"),
                    text.clean_list(F.lit(None).cast("array<string>")).alias("n")).head()
    assert row["c"] == ["Deep", "deep", "X y"]
    assert row["u"] == ["Deep", "X y"]
    assert row["n"] == []


def test_parse_authors(spark):
    assert one(spark, text.parse_authors(F.col("v")), "Alice  Zhang and Bob Wang, alice zhang,, Cy", "", "Anderson") == [
        ["Alice Zhang", "Bob Wang", "Cy"], [], ["Anderson"]]


def test_stable_id(spark):
    got = one(spark, text.stable_id(F.lit(2024), F.col("v")), "Open-Vocabulary Scene Understanding")
    assert got == ["cvpr-2024-open-vocabulary-scene-understanding-bbc8690b8b"]
    assert one(spark, text.stable_id(F.lit(2024), F.col("v"), "x"), "é" * 3)[0].startswith("x-2024--")


def test_parse_instant(spark):
    values = ["2026-06-25T00:00:00Z", "2026-06-25T00:00:00+00:00", "zz", None, "2026"]
    lenient = [str(t) for t in one(spark, text.parse_instant(F.col("v"), now()).cast("string"), *values)]
    strict = [str(t) for t in one(spark, text.parse_instant(F.col("v"), now(), strict=True).cast("string"), *values)]
    at, late = "2026-06-25 00:00:00", "2026-01-01 00:00:00"
    assert lenient == [at, at, late, late, late]
    assert strict == [at, late, late, late, late]


GOLDEN_KEYWORDS = [
    ("Open-Vocabulary Scene Understanding ", ["open vocabulary", "scene understanding", "open", "scene", "understanding", "vocabulary"]),
    ("Vision-Language Object Detection A foundation model for open vocabulary object detection.",
     ["foundation model", "object detection", "open vocabulary", "vision language", "detection", "object", "foundation", "language"]),
    ("Vision language model for semantic segmentation",
     ["language model", "semantic segmentation", "vision language", "language", "segmentation", "semantic", "vision"]),
    ("few - shot", ["few", "shot"]),
    ("3dmodels", ["dmodels"]),
    ("few-shot", ["few shot", "few", "shot"]),
    ("", []),
    ("the model", []),
]


def test_keywords_golden(spark):
    got = one(spark, keywords.extract_keywords(F.col("v")), *[t for t, _ in GOLDEN_KEYWORDS])
    assert got == [k for _, k in GOLDEN_KEYWORDS]


def test_keywords_count_what_a_text_was_made_of(spark):
    """Texts built from known terms: the score of a term is how often it was put in, a phrase counts once."""
    rng = random.Random(3)
    terms = ["gear", "lens", "robot", "surface", "a1b", "texture", "mesh", "scan", "pose", "depthmap"]
    made = [[rng.choice(terms) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    got = one(spark, keywords.extract_keywords(F.col("v"), phrases=[]), *[rng.choice([" ", ", ", "\n"]).join(m) for m in made])
    for words, found in zip(made, got):
        ranked = sorted(set(words), key=lambda w: (-words.count(w), w))
        assert found == ranked[:8]


def test_keywords_one_word_phrase_and_stopword(spark):
    options = {"phrases": ["model", "few shot"], "stopwords": ["model", "few"]}
    value = "few shot model model gear gear gear gear gear"
    assert one(spark, keywords.extract_keywords(F.col("v"), **options), value) == [["gear", "few shot", "model", "shot"]]


def test_phrases_overlap_and_count_once(spark):
    assert one(spark, keywords.phrase_hits(F.col("v")), "vision language model, vision-language") == [["language model", "vision language"]]


def test_unescape_equals_library(spark):
    values = ["a &amp; b", "&amp;lt;", "&lt;b&gt;", "&copy &amp", "&#233;&eacute;", "&nosuch; &", "&quot;x&#39;", "AT&T", "&middot;&nbsp;z", None, "&ampx"]
    assert one(spark, markup.unescape(F.col("v")), *values) == [None if v is None else html.unescape(v) for v in values]


def test_clean_html(spark):
    assert one(spark, markup.clean_html(F.col("v")), "<b>a</b>b &amp;\n <i class='x'>c</i>", None) == ["a b & c", ""]


@pytest.mark.parametrize("base", ["http://h.example.org/a/b/c.html?q=1", "https://h.example.org", "relative/base"])
def test_resolve_url_equals_library(spark, base):
    refs = ["x.html", "/x", "../x", "./x", "//o.example.org/p", "https://a.example.org/../b", "", "?q", "#f", "/a/../b", "/a#", "http://z/?", " /x", "mailto:a@b"]
    assert one(spark, markup.resolve_url(F.lit(base), F.col("v")), *refs) == [urljoin(base, r) for r in refs]


def test_like_without_accents(spark):
    import random
    import re

    from quillstream.functions.text import contains_pattern, fold_text, folded

    rng = random.Random(3)
    made = ["José", "JOSE\u0301 ", "straße", "Ångström", "naïve café", "a%b_c\\d", "x\ny", "🙂é", "", None] + ["".join(rng.choice("aábB%_.é\\") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    queries = ["jose", "STRASSE", "_a%é", "n%v_ c", "\\%b", "\\_", "\\\\d", "x_y", "_e", "a.b", "%", "", "a%b%a%b", "[b", "b\\"] + ["".join(rng.choice("aáb%_") for _ in range(rng.randint(1, 4))) for _ in range(30)]

    def like(text, q):
        out, literal = "", False
        for ch in folded(q):
            if ch == "\\" and not literal:
                literal = True
                continue
            out += ".*" if ch == "%" and not literal else "." if ch == "_" and not literal else re.escape(ch)
            literal = False
        return re.search(out, folded(text), re.DOTALL) is not None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    got = df.select("i", "t", fold_text(F.col("t")).alias("folded"), *[fold_text(F.col("t")).rlike(contains_pattern(folded(q))).alias(f"q{k}") for k, q in enumerate(queries)]).collect()
    for r in got:
        assert r["folded"] == (None if r["t"] is None else folded(r["t"]))
        if r["t"] is not None:
            assert [r[f"q{k}"] for k in range(len(queries))] == [like(r["t"], q) for q in queries], r["t"]
    # a pattern of many pieces does not go back over a long text
    long = spark.range(1).select(F.repeat(F.lit("ab"), 200_000).alias("t"))
    assert long.where(F.col("t").rlike(contains_pattern("a%b%a%b%a%b%a%c"))).count() == 0


def test_only_texts_with_a_phrase_word_are_cleaned(spark):
    rng = random.Random(5)
    parts = ["few", "shot", "Few-Shot", "few_shot", "object", "detection", " ", "  ", "-", "/", "é", "\x1c", "\n", "İ", "x"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    phrases = ["few shot", "object detection", "shot", "é", "few  shot", "few-shot", ""]
    table = spark.createDataFrame([(v,) for v in values], "v string")
    found = table.select(keywords.phrase_hits(F.col("v"), phrases).alias("hits"), keywords.keyword_text(F.col("v")).alias("clean"))
    assert all(r["hits"] == [p for p in phrases if p in r["clean"]] for r in found.collect())
    shown = table.select(keywords.phrase_hits(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.index("CASE WHEN") < shown.index("regexp_replace")

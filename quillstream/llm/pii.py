"""Operator 13: personal data by fixed forms and by bootstrapped contexts, in DataFrame functions only.

Matches of the fixed forms are seeds. The words around a seed are its patterns;
other identifier-like stretches of text that stand in the same patterns are
candidates. A pattern is trusted for a kind by the share of its distinct values
that are known to be of that kind, a value by the patterns it stands in, and the
two are computed from each other for some rounds. In the end a candidate that
stands in a trusted pattern is a span as well. Seeds stay whatever the patterns say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstream.llm.common import BLANKS, written

KINDS = ("email", "ip", "card", "phone")

# The forms as stated, in a shape that takes no more than linear time: a match may only begin where a run
# of its first characters does (or the last match ended), and runs are possessive, as what follows can't be in them.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A form can only match a text that contains this.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Stretches that may be identifiers: numbers with separators, and words that hold a digit, an @ or inner punctuation.
CANDIDATE = (r"(?<![A-Za-z0-9_.@%+()\[\]-])(?:[+(]{0,2}+[0-9]++(?![A-Za-z0-9_@%])(?:[\x20().-]{1,2}+[0-9]++(?![A-Za-z_@%]))*+"
             r"|[+(\[]{0,2}+[A-Za-z]*+(?:[0-9@]|[._(\[-]++[A-Za-z0-9])[A-Za-z0-9_.@%+()\[\]-]*+)")
#: What a candidate, in lower case, must look like to be of a kind.
SHAPES = {
    "email": r"^[a-z0-9._%+-]+[@(\[].*[a-z]",
    "ip": r"^[0-9]+(?:[.:-][0-9]+){2,7}$",
    "card": r"^[0-9](?:[\x20.-]?[0-9]){7,22}$",
    "phone": r"^[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){5,16}$",
}
#: Luhn's sums of doubled digits.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = F.array(*[F.lit(d) for d in DOUBLED])
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, F.get(doubled, value(i))).otherwise(value(i)))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The conditions beyond the form."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: A pattern is trusted at this confidence, and from this many known values.
CONFIDENCE, SUPPORT = 0.75, 3
ROUNDS = 3


def with_sums_before(rows: DataFrame, values: str, out: str) -> DataFrame:
    """``rows`` with the sums of all elements before each one of ``values``; by blocks, as one growing array would take quadratic time."""
    n = F.size(values)
    block = F.greatest(F.lit(64), F.ceil(F.sqrt(n.cast("double")))).cast("int")
    zero = F.lit(0).cast("bigint")

    def sums(array: Column, start: Column) -> Column:
        return F.aggregate(array, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    rows = rows.withColumn("_blocks", F.when(n > 0, blocks).otherwise(F.array().cast("array<array<bigint>>")))
    starts = sums(F.transform("_blocks", lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero)
    inner = F.zip_with("_blocks", F.slice(starts, F.lit(1), F.size("_blocks")), lambda b, s: F.slice(sums(b, s), F.lit(1), F.size(b)))
    return rows.withColumn(out, F.flatten(inner)).drop("_blocks")


def with_matches(rows: DataFrame, form: str, out: str, needs: str = "") -> DataFrame:
    """``rows`` with the leftmost non-overlapping matches of ``form`` in ``text``, in order.

    Each has start and end in code points, its value, and the text before and behind it up to the next match.
    """
    some = F.col("text").contains(needs)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_values", F.when(some, F.regexp_extract_all("text", F.lit(form), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_pieces", F.when(F.size("_values") > 0, F.split("text", form, -1)).otherwise(none))
    rows = rows.withColumn("_lengths", F.zip_with("_values", F.slice("_pieces", F.lit(1), F.size("_values")), lambda v, p: (F.length(v) + F.length(p)).cast("bigint")))
    rows = with_sums_before(rows, "_lengths", "_starts")
    left, right = F.slice("_pieces", F.lit(1), F.size("_values")), F.slice("_pieces", F.lit(2), F.size("_values"))
    together = F.arrays_zip(F.col("_values").alias("v"), F.col("_starts").alias("s"), left.alias("l"), right.alias("r"))
    found = F.transform(together, lambda z: F.struct(
        (z["s"] + F.length(z["l"])).alias("start"), (z["s"] + F.length(z["l"]) + F.length(z["v"])).alias("end"), z["v"].alias("value"), z["l"].alias("left"), z["r"].alias("right")))
    return rows.withColumn(out, found).drop("_values", "_pieces", "_lengths", "_starts")


# --- contexts --------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[{BLANKS}]+"), "")


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of a place: the two words before it, the one before, and the one before with the one behind.

    Words are lower-cased, 64 characters on either side are looked at; a place
    without a word before it has no pattern.
    """
    made = lambda w, r: F.when(F.size(w) > 0, F.concat(
        F.when(F.size(w) > 1, F.array(F.concat(F.lit("2:"), F.get(w, F.size(w) - 2), F.lit(" "), F.get(w, F.size(w) - 1)))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("1:"), F.get(w, F.size(w) - 1)), F.concat(F.lit("r:"), F.get(w, F.size(w) - 1), F.lit(" _ "), F.coalesce(F.get(r, F.lit(0)), F.lit(""))))))
    # one element, so that the words are split once
    once = F.transform(F.array(F.struct(_words(F.right(left, F.lit(64))).alias("w"), _words(F.left(right, F.lit(64))).alias("r"))), lambda x: made(x["w"], x["r"]))
    return F.coalesce(F.get(once, F.lit(0)), F.array().cast("array<string>"))


def _trimmed(value: Column) -> Column:
    """Without what follows the last letter or digit."""
    return F.regexp_replace(value, "(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")


def _valid(kind: str) -> Callable:
    return lambda m: _holds(kind, m["value"])


def _span(rank: int) -> Callable:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("kind"), m["end"].alias("end"))


def _place(kind: Column, cut: Callable) -> Callable:
    return lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(cut(m["value"]))).alias("end"), F.lower(cut(m["value"])).alias("value"),
                              kind.alias("kind"), patterns(m["left"], m["right"]).alias("patterns"))


def _of_kind(rank: int) -> Callable:
    return lambda s: s["kind"] == rank


def seeds(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, places) of every row, written: spans of the fixed forms, and places they or candidates are at.

    ``base`` has start, rank of the kind and end, in order; ``places`` value, kind
    (null for candidates, which may overlap others still) and patterns.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = with_matches(rows, FORMS[kind], f"_{kind}", NEEDS[kind])
        rows = rows.withColumn(f"_{kind}", F.filter(f"_{kind}", _valid(kind)))
    rows = with_matches(rows, CANDIDATE, "_others")
    base = [F.transform(f"_{k}", _span(r)) for r, k in enumerate(KINDS)]
    places = [F.transform(f"_{k}", _place(F.lit(r), lambda v: v)) for r, k in enumerate(KINDS)]
    places.append(F.transform("_others", _place(F.lit(None).cast("int"), _trimmed)))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*places).alias("places")), "pii-seeds")


def apart(places: DataFrame) -> DataFrame:
    """``places`` (row, start, end, kind, ...) without candidates that overlap a span with a kind.

    What starts no later than a candidate is judged by the furthest end so far, what
    starts behind it by the nearest start to come; a group is one text.
    """
    known = F.col("kind").isNotNull()
    so_far = Window.partitionBy("row").orderBy("start", F.col("kind").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    to_come = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    marked = places.withColumn("_end", F.max(F.when(known, F.col("end"))).over(so_far)).withColumn("_start", F.min(F.when(known, F.col("start"))).over(to_come))
    overlaps = F.coalesce(F.col("_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_start") < F.col("end"), F.lit(False))
    return marked.where(known | ~overlaps).drop("_end", "_start")


def _shaped(value: Column, kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == r, value.rlike(SHAPES[k])) for r, k in enumerate(KINDS)])


def trusted_patterns(places: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that can be trusted, written.

    A pattern's confidence in a kind is the summed score of its distinct values of
    that kind over their number plus one; a seed scores one. A candidate's score is
    the chance that one of its trusted patterns is right, and its kind the likeliest.
    """
    edges = written(places.select(F.explode("patterns").alias("pattern"), "value").distinct(), "pii-edges")
    known = places.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"))
    known = accepted = written(known, "pii-known")
    ranks = F.explode(F.array(*[F.struct(F.lit(r).alias("kind"), F.col(f"s{r}").alias("score"), F.col(f"n{r}").alias("known")) for r in range(len(KINDS))]))
    for k in range(rounds):
        per = edges.join(accepted, "value", "left").groupBy("pattern").agg(
            F.count("*").alias("n"), *[F.coalesce(F.sum(F.when(F.col("kind") == r, F.col("score"))), F.lit(0.0)).alias(f"s{r}") for r in range(len(KINDS))],
            *[F.count(F.when(F.col("kind") == r, 1)).alias(f"n{r}") for r in range(len(KINDS))])
        trusted = per.select("pattern", "n", ranks.alias("k")).select("pattern", "k.kind", (F.col("k.score") / (F.col("n") + 1)).alias("confidence"), "k.known")
        trusted = written(trusted.where((F.col("confidence") >= confidence) & (F.col("known") >= support)).drop("known"), "pii-trusted")
        if k == rounds - 1 or trusted.isEmpty():
            break
        proposed = edges.join(trusted, "pattern").where(_shaped(F.col("value"), F.col("kind"))).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = proposed.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("b")).select("value", (-F.col("b.rank")).alias("kind"), F.col("b.score").alias("score"))
        accepted = written(known.unionByName(best.join(known, "value", "left_anti")), "pii-accepted")
    return trusted


def spans(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, base, added): one row for each row; spans as start, rank of the kind in KINDS and end, by start and kind.

    A null text is an empty one and has no spans. Ids may repeat or be null; rows are
    told apart by a number of their own. Other columns of any name are ignored. A
    value counts once for a pattern, however many copies of a text hold it. Ties of
    kinds go to the one listed first. No rows give no rows.
    """
    rows = seeds(docs)
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    places = written(apart(places), "pii-places")
    trusted = trusted_patterns(places, rounds, confidence, support)
    hits = places.where("kind IS NULL").select("row", "start", "end", "value", F.explode("patterns").alias("pattern")).join(trusted, "pattern")
    hits = hits.where(_shaped(F.col("value"), F.col("kind"))).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("rank"))).alias("b"))
    added = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.rank")).alias("kind"), "end"))).alias("added"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def _listed(all_spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of :func:`spans`; the numbers by kind are of the fixed forms."""
    numbers = [F.size(F.filter("base", _of_kind(r))).cast("bigint").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return spans(docs).select("doc_id", *numbers, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                              _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))

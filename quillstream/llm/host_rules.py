"""Operator 5: quality rules with a verdict on hosts, in DataFrame functions only.

Every document is measured and tested against a few rules. A host's failure rate
under a rule is shrunk towards the rate of all hosts by an empirical beta prior,
so a host with few documents is not condemned by one of them, and a host whose
shrunk rate under any rule exceeds ``limit`` is rejected with all its documents.
What chance alone makes rates differ by is no sign that hosts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstream.llm.common import BLANKS, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Bounds of the prior's strength in documents: hosts that differ as much as can be, and no more than by chance.
STRENGTH = (1.0, 1000.0)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rule name -> a document fails it. ``base`` alone also rejects the document itself.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "20 * n_dup_lines > n_words",
}


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII blanks."""
    return F.array_remove(F.split(text, f"[{BLANKS}]+"), "")


def _joined(hashes: Column, distance: int) -> Column:
    """Hashes of each element with the one ``distance`` behind it; as many fewer elements."""
    n = F.greatest(F.size(hashes) - distance, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(distance + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeat_words(n: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more; ``windows`` holds their hashes in order."""
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Neighbours in sorted order, one before and one after, without looking outside the element.
    near = F.arrays_zip(numbered.alias("x"), F.concat(F.array(F.lit(None)), numbered.getField("h")).alias("before"),
                        F.concat(F.slice(numbered.getField("h"), 2, F.size(windows)), F.array(F.lit(None))).alias("after"))
    same = F.filter(near, lambda e: (e["x"]["h"] == e["before"]) | (e["x"]["h"] == e["after"]))
    at = F.sort_array(F.transform(same, lambda e: e["x"]["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("bigint").alias("n"))
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES, all bigint; a null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_words", words(text))
    n = F.size("_words")
    # Windows of eight words from hashes of words, pairs and fours.
    rows = rows.withColumn("_windows", F.transform("_words", lambda w: F.xxhash64(w)))
    for distance in (1, 2, 4):
        rows = rows.withColumn("_windows", _joined(F.col("_windows"), distance))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    rows = rows.withColumn("_lines", lines)
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_repeat_words(n, F.col("_windows")))
    return rows.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeats.cast("bigint"),
    }).drop("_words", "_windows", "_lines")


def host_verdicts(rows: DataFrame, limit: float = 0.5, host: str = "source") -> DataFrame:
    """(host column, n_docs, rate_<rule>..., host_rejected) from measured rows; null is a host of its own.

    The prior of a rule is a beta distribution with the mean of all documents. Its
    strength is fitted by moments: hosts weighted by their documents vary by chance,
    as their sizes say, and by the correlation within hosts, which is what is left.
    The correlation is one over the strength plus one.
    """
    failures = {f"f_{r}": F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")) for r, rule in RULES.items()}
    hosts = written(rows.groupBy(host).agg(F.count("*").alias("n_docs"), *[v.alias(k) for k, v in failures.items()]), "hosts")
    rates = {}
    for rule in RULES:
        failed, n = F.col(f"f_{rule}"), F.col("n_docs")
        mean, free = F.sum(failed) / F.sum(n), F.count("*") - 1
        spread = F.sum(failed * failed / n) - F.sum(failed) * mean
        # hosts of one document each tell nothing about hosts
        telling = F.sum(n) - F.sum(n * n) / F.sum(n) - free
        correlation = F.when((mean > 0) & (mean < 1) & (telling > 0), (spread / (mean * (1 - mean)) - free) / telling)
        strength = F.when(correlation > 0, F.least(F.greatest(1 / correlation - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).otherwise(F.lit(STRENGTH[1]))
        prior = hosts.agg(F.struct(mean.alias("mean"), strength.alias("strength"))).scalar()
        rates[f"rate_{rule}"] = (F.col(f"f_{rule}") + prior["mean"] * prior["strength"]) / (F.col("n_docs") + prior["strength"])
    rejected = F.greatest(*[F.col(r) for r in rates]) > limit
    return hosts.withColumns(rates).withColumn("host_rejected", rejected).select(host, "n_docs", *rates, "host_rejected")


def judged(docs: DataFrame, limit: float = 0.5, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with MEASURES, ``base_failed`` and ``kept``, one row for each row.

    Ids may repeat or be null. Columns of ``docs`` with the names of added ones are
    replaced. No rows give no rows. The measured rows are written once; hosts are
    joined back to them, which splits the rows of a hot host.
    """
    added = [*MEASURES, "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = measured(docs.drop(*added)).withColumn("base_failed", F.expr(RULES["base"]))
    rows = written(rows.select(*keep, F.col(host).alias("_host"), *MEASURES, "base_failed"), "measured")
    verdicts = host_verdicts(rows, limit, "_host").select(F.col("_host").alias("_judged"), F.col("host_rejected").alias("_rejected"))
    joined = rows.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("_rejected", F.lit(False))
    return joined.select(*keep, *MEASURES, "base_failed", kept.alias("kept"))

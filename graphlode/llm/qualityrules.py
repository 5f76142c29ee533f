"""Quality rules whose thresholds adapt to each language and source.

Every document is measured once, over its whole text.  For each (lang, source)
the measures of the documents that pass the base rule go into log-bucket quantile
sketches: a value x above nought lands in bucket ceil(log(x) / log(gamma)), and a
sketch is its bucket counts.  Sketches merge by adding counts, so they are built by
an ordinary aggregation with map-side combining (a hot source costs at most a few
thousand rows per task), they do not depend on the order of rows, and a quantile
read from one is within ``gamma - 1`` of the true value.

A document is kept if it passes the base rule and each measure lies within the
fences of its group, ``REACH`` interquartile ranges beyond its quartiles.  Where a
group's spread is near nought its range counts as the least that ``RULES`` gives (for
the measures of wording, as half of its language's range at least), and a few symbols, repeated words and repeated lines are free (``FREE``), so one of them
in a short text rejects nothing.  A group of fewer than ``least_group`` documents is
judged by the merged sketch of its language, or else by that of all documents.

Null ``lang`` and ``source`` are groups of their own.  Null and empty texts have no
words and fail the base rule.  With no document that passes it there are no fences,
and nothing is kept.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import annotate, stash

GAMMA = 1.005
REACH = 4
LEAST_GROUP = 30
#: Per thousand words (or lines), in letters per thousand words, or distinct words per thousand of n^0.85 words.
#: Sides that are judged, and the least interquartile range: a number; or a share of the median, and half of the language's.
RULES = {
    "symbol_rate": ("high", 5.0, 0.0),
    "repeat_rate": ("high", 25.0, 0.0),
    "dup_line_rate": ("high", 50.0, 0.0),
    "mean_word": ("both", 0.0, 0.02),
    "distinct_rate": ("low", 0.0, 0.05),
}
#: Symbols, repeated words (a passage of 20 words, said twice) and repeated lines that the fences do not count.
FREE = {"n_symbols": 2, "n_repeat_words": 40, "n_dup_lines": 2}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long"
SYMBOLS = b"#*$%&|<>"


def repeat_words(w: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    grams = list(zip(w, w[1:], w[2:]))
    if len(set(grams)) == len(grams):
        return 0
    times, covered, reach = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def measure_bodies(bodies: list[bytes]):
    rows = []
    for body in bodies:
        w = body.split()
        seen, dups, with_words = set(), 0, 0
        for line in body.split(b"\n"):
            if line and not line.isspace():
                with_words += 1
                if line in seen:
                    dups += 1
                seen.add(line)
        blanks = len(body) - sum(map(len, w))
        rows.append((len(w), len(body.decode("utf-8", "replace")) - blanks, len(body) - len(body.translate(None, SYMBOLS)), dups, repeat_words(w), with_words, len(set(w))))
    return list(zip(*rows)) if rows else [[]] * 7


def measure(docs: DataFrame, carry=("doc_id", "lang", "source")) -> DataFrame:
    found = annotate(docs, measure_bodies, MEASURES, carry)
    per = lambda x, of: F.when(of > 0, 1000.0 * x / of).otherwise(0.0)
    beyond = lambda c: F.greatest(F.col(c) - FREE[c], F.lit(0))
    return found.select(
        "*",
        per(beyond("n_symbols"), F.col("n_words")).alias("symbol_rate"),
        per(beyond("n_repeat_words"), F.col("n_words")).alias("repeat_rate"),
        per(beyond("n_dup_lines"), F.col("n_lines")).alias("dup_line_rate"),
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
        per(F.least("n_words", F.col("n_distinct") + FREE["n_repeat_words"]), F.pow(F.col("n_words").cast("double"), 0.85)).alias("distinct_rate"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per lang, source and measure of what passes the base rule: mergeable by addition."""
    bucket = lambda c: F.when(F.col(c) > 0, F.ceil(F.log(F.col(c)) / math.log(GAMMA)).cast("int"))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), bucket(c).alias("bucket")) for c in RULES)))
    good = measured.filter("NOT base_failed").select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), each)
    return good.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """One row per group: its documents (``total``) and, for each measure, ``q1``, ``q2`` and ``q3``.

    A group has at most a few thousand buckets, whatever the number of its documents.
    """
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*group, "measure")
    upto = of.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select("*", value.alias("value"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("all"))
    q = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("all")), F.col("value")))
    return ranked.groupBy(*group).pivot("measure", list(RULES)).agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.first("all").alias("total"))


def fences(sketch: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per lang and source with a low and a high fence for each measure."""
    any_measure = next(iter(RULES))
    names = [f"{m}_{q}" for m in RULES for q in ("q1", "q2", "q3")]
    packed = lambda level: F.when(F.col(f"{any_measure}_total") >= least_group, F.struct(*names)).alias(level)
    own = quartiles(sketch, "lang", "source").select("lang", "source", packed("own"))
    by_lang = quartiles(sketch, "lang").select(F.col("lang").alias("lang2"), packed("wider"))
    overall = quartiles(sketch.withColumn("one", F.lit(1)), "one").first()  # one row, whatever the corpus
    widest = F.struct(*(F.lit(overall[x] if overall else None).cast("double").alias(x) for x in names))
    # Groups that only failing documents are in have no sketch; their documents need no fences.
    q = F.coalesce("own", "wider", widest)
    wide = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang2")), "left").select("lang", "source", q.alias("q"), F.coalesce("wider", widest).alias("w"))
    out = [F.col("lang").alias("lang_"), F.col("source").alias("source_")]
    for m, (sides, least, share) in RULES.items():
        q1, q2, q3 = (F.col(f"q.{m}_{x}") for x in ("q1", "q2", "q3"))
        of_language = F.col(f"w.{m}_q3") - F.col(f"w.{m}_q1")
        spread = REACH * (F.greatest(q3 - q1, share * q2, of_language / 2) if share else F.greatest(q3 - q1, F.lit(least)))
        out.append((F.lit(-1.0) if sides == "high" else q1 - spread).alias(f"{m}_low"))
        out.append((F.lit(math.inf) if sides == "low" else q3 + spread).alias(f"{m}_high"))
    return wide.select(*out)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``.

    The limits are a written table, so Spark knows their size before it plans: it
    broadcasts them if that allows, else it splits a hot source.
    """
    within = ~F.col("base_failed")
    for m in RULES:
        within = within & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    same = F.col("row.lang").eqNullSafe(F.col("lang_")) & F.col("row.source").eqNullSafe(F.col("source_"))
    return measured.join(limits, same, "left").withColumn("kept", F.coalesce(within, F.lit(False)))


def quality_rules(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Measures and verdict for each document; the text is read once."""
    measured = stash(measure(docs), "quality-measures")
    sketch = stash(sketches(measured), "quality-sketches", few=True)
    return judge(measured, stash(fences(sketch, least_group), "quality-limits", few=True))


def keep_good(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured a second time beside their limits, so they are never shuffled.
    """
    sketch = stash(sketches(measure(docs)), "quality-sketches", few=True)
    limits = stash(fences(sketch, least_group), "quality-limits", few=True)
    return judge(measure(docs, carry=docs.columns), limits).filter("kept").select("row.*")

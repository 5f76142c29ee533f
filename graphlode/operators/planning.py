"""Planning: concept footprints, fused change sets, edit sessions, questions and answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.functions import text as tx

#: Endings that a stem loses, longest first (fixed values).
ENDINGS = ("ations", "ation", "ings", "ing", "ies", "ers", "es", "ed", "er", "s")


def stem(word: str) -> str:
    word = word.lower()
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            return word[: -len(e)]
    return word


def footprint(items: DataFrame, concept: str, key: str, group: str, name: str, per_group: int) -> DataFrame:
    """Items whose name meets a concept, the best per group first; ``total`` tells what the cap leaves out.

    The match is ranked before the cap: equal, word start, anywhere.
    """
    s = stem(concept)
    low = F.lower(F.col(name))
    fit = F.when(low == concept.lower(), 3).when(low.rlike(rf"(^|[^a-z]){re.escape(s)}"), 2).when(F.contains(low, F.lit(s)), 1).otherwise(0)
    w = Window.partitionBy(group)
    rows = items.withColumn("fit", fit).filter("fit > 0").withColumn("turn", F.row_number().over(w.orderBy(F.desc("fit"), key))).withColumn("total", F.count("*").over(w))
    return rows.filter(F.col("turn") <= per_group).select(group, key, "fit", "turn", "total")


def change_set(arms: dict[str, tuple[DataFrame, float]], primary: int) -> DataFrame:
    """Files (``file``, ``score`` in each arm) fused by weight; the first ``primary`` with more than one arm or a strong one lead.

    A file that only a broad arm (weight under a half) names is never primary.
    """
    rows = None
    for name, (arm, weight) in arms.items():
        one = arm.select("file", (F.col("score") * weight).alias("part"), F.lit(name).alias("arm"), F.lit(weight >= 0.5).alias("strong"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("file").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"), F.bool_or("strong").alias("strong"))
    turn = F.row_number().over(Window.partitionBy("strong").orderBy(F.desc("score"), "file"))
    return fused.withColumn("turn", turn).select("file", "score", "arms", (F.col("strong") & (F.col("turn") <= primary)).alias("is_primary"))


def session_drift(planned: DataFrame, edited: DataFrame) -> DataFrame:
    """Planned against edited files of each session: done, skipped or unplanned."""
    a, b = planned.select("session", "file").distinct().withColumn("p", F.lit(True)), edited.select("session", "file").distinct().withColumn("e", F.lit(True))
    status = F.when(F.col("p") & F.col("e"), "done").when(F.col("p"), "skipped").otherwise("unplanned")
    return a.join(b, ["session", "file"], "full_outer").select("session", "file", status.alias("status"))


def check_contract(rows: DataFrame, answer: DataFrame) -> DataFrame:
    """A checkpoint's rows (``row_no``, ``digest``) against an answer's, in order."""
    a, b = rows.toDF("row_no", "want"), answer.toDF("row_no", "got")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("got"), "ok").otherwise("changed")
    return a.join(b, "row_no", "full_outer").select("row_no", status.alias("status"))


def common_ingredients(exemplars: DataFrame, least: int) -> DataFrame:
    """Ingredients (``kind``, ``item``) that at least so many exemplar files share."""
    return exemplars.select("file", "kind", "item").distinct().groupBy("kind", "item").agg(F.count("*").alias("files")).filter(F.col("files") >= least)


def guard_status(functions: DataFrame, calls: DataFrame, guards: DataFrame) -> DataFrame:
    """Functions that call a guard themselves or by one helper, that call none, or of which no call is known."""
    direct = calls.join(guards.select(F.col("guard").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("function"))
    helped = calls.join(direct.select(F.col("function").alias("callee")).distinct(), "callee", "left_semi").select(F.col("caller").alias("function"))
    guarded = direct.unionByName(helped).distinct().withColumn("g", F.lit(True))
    known = calls.select(F.col("caller").alias("function")).distinct().withColumn("c", F.lit(True))
    status = F.when(F.col("g"), "guarded").when(F.col("c"), "unguarded").otherwise("unknown")
    return functions.select("function").distinct().join(guarded, "function", "left").join(known, "function", "left").select("function", status.alias("status"))


#: Intent of a question by its words (fixed values).
INTENTS = [
    ("impact", r"\b(?:break|impact|affect|depend)"),
    ("history", r"\b(?:when|who changed|history|commit|last changed)\b"),
    ("location", r"\b(?:where|which file|find)\b"),
    ("reason", r"\b(?:why|reason|because)\b"),
    ("procedure", r"\b(?:how (?:do|to|can)|steps)\b"),
    ("definition", r"\b(?:what is|what does|explain|define)\b"),
]


def plan_question(question: str) -> dict:
    """Intents, named entities and qualifiers of a question."""
    low = question.lower()
    intents = [n for n, p in INTENTS if re.search(p, low)] or ["general"]
    entities = re.findall(r"`([^`]+)`|\b([A-Z]\w*[a-z]\w*[A-Z]\w*|\w+\.\w+(?:\.\w+)*|\w+_\w+)\b", question)
    paths = re.findall(r"\b[\w/\\]+\.(?:vb|cs|py|rs|js|ts|sql|aspx)\b", question)
    return {"intents": intents, "entities": [a or b for a, b in entities], "paths": paths, "negated": bool(re.search(r"\b(?:not|never|without)\b", low))}


def dedup_evidence(rows: DataFrame, key: str) -> DataFrame:
    """The best scored of each key, and one per path."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    per_path = Window.partitionBy("path").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("a", F.row_number().over(best)).filter("a = 1")
    return rows.withColumn("b", F.row_number().over(per_path)).filter("b = 1").drop("a", "b")


def conflicts(facts: DataFrame) -> DataFrame:
    """Subjects with facts that say both a thing and its contrary (``subject``, ``positive``)."""
    return facts.groupBy("subject").agg(F.count_if("positive").alias("yes"), F.count_if(~F.col("positive")).alias("no")).filter("yes > 0 AND no > 0")


def answer_status(evidence: DataFrame, key: str) -> DataFrame:
    """Answered, partial, stale, ambiguous or unsupported, from the evidence of each question."""
    agg = evidence.groupBy(key).agg(
        F.count("score").alias("n"), F.max("score").alias("best"), F.bool_and(F.coalesce("stale", F.lit(False))).alias("all_stale"), F.count_distinct(F.when(F.col("score") >= 0.6, F.col("subject"))).alias("subjects")
    )
    status = F.when(F.col("n") == 0, "unsupported").when(F.col("all_stale"), "stale").when(F.col("subjects") > 1, "ambiguous").when(F.col("best") >= 0.6, "answered").otherwise("partial")
    return agg.select(key, status.alias("status"), "n")


def lexicon(pairs: DataFrame) -> DataFrame:
    """Terms of two languages that name one resource (``resource``, ``language``, ``value``)."""
    a = pairs.select("resource", F.col("language").alias("from_language"), F.lower("value").alias("term"))
    b = pairs.select("resource", F.col("language").alias("to_language"), F.lower("value").alias("translation"))
    return a.join(b, "resource").filter("from_language != to_language").select("from_language", "term", "to_language", "translation").distinct()


def corroboration(text: Column, terms: Sequence[str]) -> Column:
    """(present - 1) / (n - 1) of the terms."""
    n = len(terms)
    present = F.size(F.array_intersect(tx.words(text), F.array(*(F.lit(t) for t in terms))))
    return F.when(present > 0, (present - 1) / float(max(1, n - 1))).otherwise(0.0)


#: Words of a story that name no concept (fixed values).
STORY_WORDS = {"about", "able", "admin", "also", "because", "could", "each", "every", "from", "have", "into", "like", "must", "need", "number", "only", "should", "that", "their", "them", "then", "there", "these", "this", "user", "want", "when", "where", "which", "with", "would"}


def story_concepts(story: str, most: int = 3) -> list[str]:
    """The first words of a story that may name a concept: four letters or more, each once."""
    return list(dict.fromkeys(w for w in re.findall(r"[^\W\d_]{4,}", story.lower()) if w not in STORY_WORDS))[:most]


def story_plan(items: DataFrame, concepts: list[str], item: str, group: str, name: str, pairs: DataFrame, per_group: int = 5, least: int = 1) -> DataFrame:
    """What a story touches: each concept's footprint, then items coupled to it (``file_a``, ``file_b``, ``weight``) that no concept names.

    ``arm`` (a concept, or ``coupled``), ``item`` and ``score`` (the fit, or the summed weight).
    """
    named = None
    for c in concepts:
        part = footprint(items, c, item, group, name, per_group).select(F.lit(c).alias("arm"), F.col(item).alias("item"), F.col("fit").cast("double").alias("score"))
        named = part if named is None else named.unionByName(part)
    if named is None:
        return items.select(F.lit("").alias("arm"), F.col(item).alias("item"), F.lit(0.0).alias("score")).filter(F.lit(False))
    seeds = named.select("item").distinct()
    both = pairs.select("file_a", "file_b", "weight").unionByName(pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "weight"))
    near = both.join(seeds.toDF("file_a"), "file_a", "left_semi").join(seeds.toDF("file_b"), "file_b", "left_anti")
    coupled = near.groupBy(F.col("file_b").alias("item")).agg(F.sum("weight").cast("double").alias("score")).filter(F.col("score") >= least)
    return named.unionByName(coupled.select(F.lit("coupled").alias("arm"), "item", "score"))

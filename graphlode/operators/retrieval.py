"""Search: BM25, nearest neighbours, rank fusion, diversification, line grep.

A query is a constant, so its terms are counted while documents are scanned; no
postings are exploded or shuffled, and document frequencies are one small row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.functions import text as tx
from graphlode.lineage import cut

K1, B = 1.2, 0.75
RRF = 60.0


def equals(word: str):
    return lambda token: token == F.lit(word)


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], mode: str = "any", tokens=tx.words) -> DataFrame:
    """``key`` and ``score`` of the documents with any, or with all, of the query's terms."""
    terms = list(dict.fromkeys(terms))
    counts = F.struct(F.size("tokens").alias("len"), *(F.size(F.filter("tokens", equals(w))).alias(f"tf{i}") for i, w in enumerate(terms)))
    # As a generator's output, counts are made once a row; filters on them would otherwise tokenize again.
    scanned = cut(docs.select(F.col(key), tokens(F.col(text)).alias("tokens")).select(key, F.inline(F.array(counts))), "term-counts")
    stats = scanned.filter("len > 0").agg(
        F.count("*").alias("n"),
        F.avg(F.col("len").cast("double")).alias("mean_len"),
        *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))),
    )

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))).otherwise(0.0)

    hits = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    wanted = hits[0]
    for h in hits[1:]:
        wanted = wanted & h if mode == "all" else wanted | h
    score = part(0)
    for i in range(1, len(terms)):
        score = score + part(i)
    return scanned.filter(wanted).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats: one row


def literal_search(docs: DataFrame, key: str, text: str, query: str, mode: str = "loose", part_weight: float = 0.1, least: int = 4) -> DataFrame:
    """``key`` and ``score`` by words and, at a tenth of the weight, by parts of words.

    Each word of the query is met as a word (a run of letters and digits, any case) or,
    if its core has ``least`` characters, as a substring (with case).  ``loose`` takes
    any word, ``strict`` all of them; ``regex`` takes substrings alone, of three
    characters or more, and all of them.  A substring counts as a phrase of its
    trigrams: its weight is the sum of theirs.  A query without words finds nothing.
    """
    asked = []
    for word in query.split():
        runs = [] if mode == "regex" else re.findall(r"[^\W_]+", word.lower())
        core = word if mode == "regex" else re.sub(r"^[\W_]+|[\W_]+$", "", word)
        core = core if len(core) >= (3 if mode == "regex" else least) else ""
        if runs or core:
            asked.append((runs, core))
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    terms = sorted({r for runs, _ in asked for r in runs})
    grams = sorted({core[i : i + 3] for _, core in asked for i in range(len(core) - 2)})

    def met(runs):  # how often the runs follow each other
        if len(runs) == 1:
            return F.size(F.filter("tokens", equals(runs[0])))
        run, n = F.array(*(F.lit(r) for r in runs)), len(runs)
        starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1)))
        return F.size(F.filter(starts, lambda i: F.slice("tokens", i, F.lit(n)) == run))

    body = F.coalesce(F.col(text), F.lit(""))
    counts = [F.size("tokens").alias("words"), F.greatest(F.char_length("body") - 2, F.lit(0)).alias("grams")]
    counts += [F.array_contains("tokens", t).cast("int").alias(f"t{i}") for i, t in enumerate(terms)]
    counts += [F.contains("body", F.lit(g)).cast("int").alias(f"g{i}") for i, g in enumerate(grams)]
    for i, (runs, core) in enumerate(asked):
        counts.append((met(runs) if runs else F.lit(0)).alias(f"w{i}"))
        counts.append((F.size(F.regexp_extract_all("body", F.lit(f"(?=({re.escape(core)}))"), F.lit(1))) if core else F.lit(0)).alias(f"s{i}"))
    held = docs.select(F.col(key), body.alias("body"), tx.words(body).alias("tokens"))
    scanned = cut(held.select(key, F.inline(F.array(F.struct(*counts)))), "literal-counts")
    stats = scanned.agg(
        F.count("*").alias("n"),
        F.avg(F.col("words").cast("double")).alias("mean_words"),
        F.avg(F.col("grams").cast("double")).alias("mean_grams"),
        *(F.sum(f"t{i}").alias(f"dt{i}") for i in range(len(terms))),
        *(F.sum(f"g{i}").alias(f"dg{i}") for i in range(len(grams))),
    )

    def weight(tf, dfs, length, mean):
        idf = F.lit(0.0)
        for df in dfs:
            idf = idf + F.log(1 + (F.col("n") - F.col(df) + 0.5) / (F.col(df) + 0.5))
        return F.when(F.col(tf) > 0, idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col(mean)))).otherwise(0.0)

    score, wanted = F.lit(0.0), F.lit(mode != "loose")
    for i, (runs, core) in enumerate(asked):
        if runs:
            score = score + weight(f"w{i}", [f"dt{terms.index(r)}" for r in runs], "words", "mean_words")
        if core:
            parts = [f"dg{grams.index(core[j : j + 3])}" for j in range(len(core) - 2)]
            score = score + (1.0 if mode == "regex" else part_weight) * weight(f"s{i}", parts, "grams", "mean_grams")
        hit = (F.col(f"w{i}") > 0) | (F.col(f"s{i}") > 0)
        wanted = wanted | hit if mode == "loose" else wanted & hit
    return scanned.crossJoin(F.broadcast(stats)).filter(wanted).select(key, score.alias("score"))  # stats: one row


def top(hits: DataFrame, score: str, keys: Sequence[str], k: int, offset: int = 0) -> DataFrame:
    """The best k, ties by key; a total order, so paging is stable."""
    return hits.orderBy(F.desc(score), *(F.asc(x) for x in keys)).offset(offset).limit(k)


def ranked(hits: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """``rank`` from 1 over a bounded list of hits."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *(F.asc(x) for x in keys))))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm > 0, norm)


def knn(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest by cosine: one scan and a top-k, no shuffle of vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, cosine(F.transform(vector, lambda x: x.cast("double")), q).alias("score"))
    return top(scored.filter("score IS NOT NULL"), "score", [key], k)


def fuse(legs: Sequence[DataFrame], key: str, base: int = 1) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (``key``, ``rank`` from 1); ``base`` 0 counts ranks from 0."""
    rows = None
    for leg in legs:
        part = leg.select(key, (1.0 / (RRF + F.col("rank") + (base - 1))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.sum("part").alias("score"))


def boost(score: Column, centrality: Column, vendor: Column) -> Column:
    """Centrality adds a little; vendor files keep a fifth."""
    raised = score + F.log(1 + F.coalesce(centrality, F.lit(0.0))) * 0.05
    return F.when(vendor, raised * 0.2).otherwise(raised)


def recency(score: Column, age_days: Column, weight: float = 0.0006, half_life: float = 30.0) -> Column:
    return score + weight * F.pow(F.lit(0.5), age_days / half_life)


def diversify(candidates: DataFrame, group: str, key: str, score: str, vector: str, k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: greedy, so each group's candidates (a bounded list) go to one call."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf[vector].tolist(), dtype=float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        worth, nearest, left, chosen = pdf[score].to_numpy(float), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for turn in range(min(k, len(pdf))):
            gain = np.where(left, balance * worth - (1 - balance) * nearest, -np.inf)
            i = 0 if turn == 0 else int(np.argmax(gain))  # ties: the better rank
            chosen.append(i)
            left[i] = False
            nearest = np.maximum(nearest, np.clip(v @ v[i], 0.0, 1.0))
        out = pdf.loc[chosen, [group, key, score]].copy()
        out["position"] = np.arange(1, len(chosen) + 1)
        return out

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {key} {kinds[key]}, {score} double, position long")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def smart_case(pattern: str) -> str:
    """Case counts only if the pattern holds an upper-case letter."""
    return pattern if any(c.isupper() for c in pattern) else "(?i)" + pattern


def check_pattern(pattern: str, most_bytes: int = 500, most_branches: int = 20) -> str:
    """Refuse patterns that are too long or have too many top-level branches."""
    depth, branches, skip = 0, 1, False
    for c in pattern:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            branches += 1
    if len(pattern.encode()) > most_bytes or branches > most_branches:
        raise ValueError("pattern is too large")
    return pattern


def grep(docs: DataFrame, key: str, text: str, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines with their context.  Documents are filtered before they are split; context stays in the row."""
    regex = smart_case(check_pattern(pattern))
    held = docs.filter(F.col(text).rlike(regex)).select(key, F.split(text, "\n").alias("all"))
    hits = held.select(key, "all", F.posexplode("all").alias("at", "line")).filter(F.col("line").rlike(regex))
    lead = F.slice("all", F.greatest(F.col("at") - before, F.lit(0)) + 1, F.least(F.lit(before), F.col("at")))
    trail = F.slice("all", F.col("at") + 2, F.lit(after))
    return hits.select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line", F.array_join(lead, "\n").alias("before"), F.array_join(trail, "\n").alias("after"))


def trigram_candidates(docs: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """Documents that hold every trigram of a literal (a superset of those that hold it)."""
    grams = sorted({literal[i : i + 3] for i in range(len(literal) - 2)})
    wanted = F.lit(True)
    for g in grams:
        wanted = wanted & F.contains(text, F.lit(g))
    return docs.filter(wanted).select(key)


def term_overlap(have: Column, query: Sequence[str], least: int = 4) -> Column:
    """Share of the query's terms that occur; nought unless ``least`` of them (or all) do."""
    q = sorted(set(query))
    n = F.size(F.array_intersect(have, F.array(*(F.lit(x) for x in q))))
    return F.when(n >= min(least, len(q)), n / F.lit(float(len(q)))).otherwise(0.0)


def diversity_slots(hits: DataFrame, kind: str, score: str, key: str, per_kind: int) -> DataFrame:
    """At most ``per_kind`` of the best of each kind."""
    w = Window.partitionBy(kind).orderBy(F.desc(score), F.asc(key))
    return hits.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= per_kind)


def rank_quality(results: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """NDCG@k, recall@k and reciprocal rank per query.

    ``results`` has (query, item, rank from 1); ``relevant`` has (query, item, position from 1).
    Graded relevance is n - position + 1; an empty list of relevant items has NDCG 0 and recall 1.
    """
    n = relevant.groupBy(query).agg(F.count("*").alias("n"))
    kept = results.filter(F.col("rank") <= k).join(relevant.select(query, item, "position"), [query, item], "left")
    return quality_of_hits(kept, n, query)


def quality_of_hits(hits: DataFrame, n: DataFrame, query: str) -> DataFrame:
    """As ``rank_quality``, from the shown results (query, rank, position among the relevant or null) and how many are relevant (query, n)."""
    log2 = lambda c: F.log(c) / F.log(F.lit(2.0))
    graded = hits.join(n, query, "left").withColumn("grade", F.col("n") - F.col("position") + 1)
    got = graded.groupBy(query).agg(
        F.sum(F.coalesce(F.col("grade") / log2(F.col("rank") + 1), F.lit(0.0))).alias("dcg"),
        F.count("grade").alias("found"),
        F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.count("*").alias("shown"),
        F.first("n").alias("n"),
    )
    # The ideal list has the relevant ones in order, as many as are shown.
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("shown", "n")), F.lit(0.0), lambda a, p: a + (F.col("n") - p + 1) / log2(p + 1))
    return got.select(
        query,
        F.coalesce(F.col("dcg") / F.when(F.col("n") > 0, ideal), F.lit(0.0)).alias("ndcg"),
        F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.col("found") / F.col("n")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def byte_page(rows: DataFrame, order: Sequence[str], text: str, budget: int, start: int = 0) -> DataFrame:
    """Rows from ``start`` on that fit a budget of bytes, over a bounded list; ``next_start`` goes on."""
    w = Window.orderBy(*order)
    numbered = rows.withColumn("turn", F.row_number().over(w) - 1).filter(F.col("turn") >= start)
    upto = F.sum(F.octet_length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = numbered.withColumn("upto", upto).filter((F.col("upto") <= budget) | (F.col("turn") == start))
    return kept.withColumn("next_start", F.col("turn") + 1).drop("upto", "turn")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks."""
    m = F.size(tokens)
    return F.when(m >= n, F.transform(F.sequence(F.lit(1), F.greatest(m - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

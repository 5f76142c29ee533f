"""Scores and verdicts over facts derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import scoring
from graphlode.plans import query

FACTS = """f AS (SELECT l_suppkey AS node, count(DISTINCT l_partkey) // 20 AS dependency, (sum((l_returnflag = 'R')::INT) // 30)::BIGINT AS sql, (sum((l_linestatus = 'O')::INT) // 50)::BIGINT AS state,
 count(DISTINCT l_linenumber) AS handles, count(*) % 9 AS polymorphism, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS pagerank, count(*) % 4 AS gis, count(*) % 6 AS script FROM lineitem GROUP BY 1)"""
RAW = """least(0.35 * least(10.0 * dependency / 50.0, 10.0) + 0.15 * least(10.0 * sql / 10.0, 10.0) + 0.15 * least(10.0 * state / 10.0, 10.0) + 0.05 * least(10.0 * handles / 15.0, 10.0)
 + 0.10 * least(10.0 * polymorphism / 8.0, 10.0) + 0.10 * least(200.0 * pagerank, 10.0) + 0.05 * least(10.0 * gis / 5.0, 10.0) + 0.05 * least(10.0 * script / 5.0, 10.0), 10.0)"""


def facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = li.count()
    return li.groupBy(F.col("l_suppkey").alias("node")).agg(
        F.floor(F.count_distinct("l_partkey") / 20).alias("dependency"),
        F.floor(F.count_if(F.col("l_returnflag") == "R") / 30).alias("sql"),
        F.floor(F.count_if(F.col("l_linestatus") == "O") / 50).alias("state"),
        F.count_distinct("l_linenumber").alias("handles"),
        (F.count("*") % 9).alias("polymorphism"),
        (F.count("*").cast("double") / n).alias("pagerank"),
        (F.count("*") % 4).alias("gis"),
        (F.count("*") % 6).alias("script"),
    )


@query(
    f"""WITH {FACTS}, r AS (SELECT node, {RAW} AS raw FROM f), s AS (SELECT node, raw, least(greatest(CAST(floor(raw + 0.5) AS BIGINT), 1), 10) AS score FROM r)
SELECT node, round(raw, 6) AS raw, score, CASE WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'medium' WHEN score <= 8 THEN 'high' ELSE 'critical' END AS band FROM s"""
)
def blast_radius(spark, sf_dir):
    return scoring.blast_radius(facts(spark, sf_dir), "node").withColumn("raw", F.round("raw", 6))


REQUESTS = """r AS (SELECT user_id AS request, count(*) AS n_files, count(*) // 2 AS downstream_dependents, round(avg(value) / max(value), 6) AS impact_confidence, CASE WHEN user_id % 9 = 0 THEN -1.0 ELSE round((user_id % 11) / 10.0, 1) END AS test_coverage,
 user_id % 4 <> 0 AS anti_pattern_clear, user_id % 3 = 0 AS touches_global_state, user_id % 5 = 0 AS touches_database FROM events GROUP BY 1)"""


def requests(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy(u.alias("request")).agg(
        F.count("*").alias("n_files"), F.floor(F.count("*") / 2).alias("downstream_dependents"), F.round(F.avg("value") / F.max("value"), 6).alias("impact_confidence")
    ).select(
        "*",
        F.when(F.col("request") % 9 == 0, -1.0).otherwise(F.round((F.col("request") % 11) / 10.0, 1)).alias("test_coverage"),
        (F.col("request") % 4 != 0).alias("anti_pattern_clear"),
        (F.col("request") % 3 == 0).alias("touches_global_state"),
        (F.col("request") % 5 == 0).alias("touches_database"),
    )


@query(
    f"""WITH {REQUESTS}, c AS (SELECT *, (impact_confidence >= 0.7)::INT + (test_coverage >= 0.6)::INT + anti_pattern_clear::INT + (downstream_dependents <= 50)::INT + (NOT touches_global_state OR impact_confidence >= 0.9)::INT
 + (NOT touches_database OR (impact_confidence >= 0.9 AND test_coverage >= 0.8))::INT AS passed,
 CASE WHEN n_files <= 3 THEN 0 WHEN n_files <= 10 THEN 1 WHEN n_files <= 30 THEN 2 ELSE 3 END + CASE WHEN downstream_dependents <= 5 THEN 0 WHEN downstream_dependents <= 20 THEN 1 WHEN downstream_dependents <= 50 THEN 2 ELSE 3 END
 + CASE WHEN touches_global_state THEN 2 ELSE 0 END + CASE WHEN touches_database THEN 2 ELSE 0 END + CASE WHEN impact_confidence < 0.5 THEN 2 WHEN impact_confidence < 0.7 THEN 1 ELSE 0 END AS points FROM r)
SELECT request, passed = 6 AS safe, round(passed / 6.0, 6) AS confidence, points::BIGINT AS points, CASE WHEN points <= 2 THEN 'low' WHEN points <= 5 THEN 'medium' WHEN points <= 8 THEN 'high' ELSE 'critical' END AS risk FROM c"""
)
def safety_policy(spark, sf_dir):
    return scoring.evaluate_safety(requests(spark, sf_dir), "request").withColumn("confidence", F.round("confidence", 6))


GATES = list(scoring.GATES.items())
GATE_SQL = ", ".join(f"CASE (event_id * {i + 3}) % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'skip' WHEN 2 THEN CASE WHEN event_id % 13 = 0 THEN 'missing' ELSE 'pass' END ELSE 'pass' END AS g{i}, ((event_id * {i + 7}) % 101) / 100.0 AS c{i}" for i in range(len(GATES)))
NAMES = {g: i for i, (g, _) in enumerate(GATES)}
HARD = " OR ".join(f"g{NAMES[g]} = 'fail'" for g in ("extraction", "safety", "retrieval", "immune"))
ANY = lambda v: " OR ".join(f"g{i} = '{v}'" for i in range(len(GATES)))
SKIPS = " + ".join(f"(g{i} = 'skip')::INT" for i in range(len(GATES)))
WEIGHT = " + ".join(f"CASE WHEN g{i} = 'skip' THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for i, (_, w) in enumerate(GATES))
VALUE = " + ".join(f"CASE WHEN g{i} = 'skip' THEN 0.0::DOUBLE ELSE {w}::DOUBLE * c{i} END" for i, (_, w) in enumerate(GATES))
DECISIONS = f"""g AS (SELECT event_id, {GATE_SQL} FROM events),
 d AS (SELECT event_id, CASE WHEN {HARD} THEN 'deny' WHEN {ANY('missing')} OR {ANY('fail')} OR {SKIPS} > 2 THEN 'abstain' ELSE 'allow' END AS verdict,
  least(greatest(coalesce(({VALUE}) / nullif({WEIGHT}, 0), 0) - CASE WHEN g{NAMES['safety']} = 'fail' AND g{NAMES['blast']} = 'fail' THEN 0.1 ELSE 0 END, 0), 1) AS confidence FROM g)"""


def gate_rows(spark, sf_dir):
    e = F.col("event_id")
    cols = {}
    for i, (g, _) in enumerate(GATES):
        r = (e * (i + 3)) % 11
        cols[g] = F.when(r == 0, "fail").when(r == 1, "skip").when((r == 2) & (e % 13 == 0), "missing").otherwise("pass")
        cols[f"{g}_confidence"] = ((e * (i + 7)) % 101) / 100.0
    return table(spark, sf_dir, "events").select("event_id", "user_id").withColumns(cols)


@query(f"WITH {DECISIONS} SELECT event_id, verdict, round(confidence, 6) AS confidence FROM d")
def adp_gates(spark, sf_dir):
    return scoring.decide(gate_rows(spark, sf_dir), "event_id").withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {DECISIONS}, i AS (SELECT event_id // 5 AS wave, verdict, confidence, event_id % 10 AS risk FROM d)
SELECT wave, CASE WHEN bool_or(verdict = 'deny') THEN 'deny' WHEN bool_or(verdict = 'abstain') OR sum((risk > 5)::INT) > 3 THEN 'abstain' ELSE 'allow' END AS verdict, max(risk) AS max_risk, round(avg(confidence), 6) AS mean_confidence, sum((risk > 5)::INT)::BIGINT AS risky, count(*) AS items FROM i GROUP BY 1"""
)
def adp_waves(spark, sf_dir):
    items = scoring.decide(gate_rows(spark, sf_dir), "event_id").select(F.floor(F.col("event_id") / 5).alias("wave"), "verdict", "confidence", (F.col("event_id") % 10).alias("risk"))
    return scoring.decide_waves(items, "wave").withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(
    f"""WITH {DECISIONS}, x AS (SELECT d.event_id, verdict, CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' ELSE 'abstain' END AS expected FROM d)
SELECT expected, verdict, count(*) AS n, sum((verdict = 'allow' AND expected <> 'allow')::INT)::BIGINT AS false_allow, sum((verdict = 'deny' AND expected = 'allow')::INT)::BIGINT AS false_deny FROM x GROUP BY 1, 2"""
)
def decision_replay(spark, sf_dir):
    """Expected against actual verdicts: a confusion table."""
    e = F.col("event_id") % 3
    rows = scoring.decide(gate_rows(spark, sf_dir), "event_id").withColumn("expected", F.when(e == 0, "allow").when(e == 1, "deny").otherwise("abstain"))
    return rows.groupBy("expected", "verdict").agg(F.count("*").alias("n"), F.count_if((F.col("verdict") == "allow") & (F.col("expected") != "allow")).alias("false_allow"), F.count_if((F.col("verdict") == "deny") & (F.col("expected") == "allow")).alias("false_deny"))


@query(
    """WITH f AS (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS files, count(*) AS calls, sum((l_returnflag = 'R')::INT)::BIGINT AS queries FROM lineitem GROUP BY 1),
 r AS (SELECT node, 'god_object' AS pattern, files AS measure, 400 AS threshold FROM f UNION ALL SELECT node, 'spaghetti', calls, 450 FROM f UNION ALL SELECT node, 'sql_coupling', queries, 100 FROM f)
SELECT node, pattern, measure::DOUBLE AS measure, CASE WHEN measure > 2 * threshold THEN 'severe' ELSE 'moderate' END AS severity FROM r WHERE measure > threshold"""
)
def design_antipatterns(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count_distinct("l_partkey").alias("files"), F.count("*").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("queries"))
    return scoring.threshold_findings(f, "node", {"god_object": ("files", 400), "spaghetti": ("calls", 450), "sql_coupling": ("queries", 100)})


@query(
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 1.0 WHEN 'view' THEN 0.95 WHEN 'click' THEN 0.7 WHEN 'purchase' THEN 0.6 ELSE 0.15 END AS a, (event_id % 10) / 10.0 AS d, (event_id % 7) / 7.0 AS r, (event_id % 3) / 3.0 AS c, (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400.0 AS age FROM events)
SELECT event_id, round(0.40 * a + 0.30 * d + 0.15 * r + 0.10 * c + 0.05 * pow(0.5, age / 30.0), 6) AS score FROM e"""
)
def evidence_ranking(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for x in ("error", "runtime", "view", "current_code", "click", "documentation", "purchase", "history", "signup", "similarity")))
    e = F.col("event_id")
    age = (F.lit(1706745600.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400.0
    score = scoring.evidence_score(scoring.authority(F.element_at(kind, F.col("event_type"))), (e % 10) / 10.0, (e % 7) / 7.0, (e % 3) / 3.0, age)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query(
    """WITH s AS (SELECT p_partkey AS item, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 50.0 END AS a, p_retailprice / 2000.0 AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0 END AS c FROM part),
 w AS (SELECT item, coalesce((coalesce(0.25 * a, 0) + 0.20 * b + coalesce(0.25 * c, 0)) / nullif(CASE WHEN a IS NULL THEN 0.0 ELSE 0.25 END + 0.20 + CASE WHEN c IS NULL THEN 0.0 ELSE 0.25 END, 0), 0) AS v FROM s)
SELECT item, round(v, 6) AS confidence, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM w"""
)
def extraction_confidence(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 2000.0).alias("b"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 10) / 10.0).alias("c")
    )
    v = scoring.weighted_confidence({"a": 0.25, "b": 0.20, "c": 0.25})
    return s.withColumn("v", v).select("item", F.round("v", 6).alias("confidence"), scoring.confidence_band(F.col("v")).alias("band"))


@query(
    """WITH f AS (SELECT l_partkey AS file, count(*) AS hits, round((l_partkey % 100) / 100.0, 2) AS sim, l_partkey % 6 = 0 AS flagged, l_partkey % 10 = 0 AS destructive FROM lineitem GROUP BY l_partkey)
SELECT file, CASE WHEN sim > 0.8 OR (flagged AND destructive AND sim > 0.15) THEN 'block' WHEN sim > 0.15 OR (hits >= 3 AND sim > 0.075) OR (flagged AND (sim > 0 OR destructive)) THEN 'warn' ELSE 'clean' END AS verdict FROM f"""
)
def immune_check(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("hits"))
    sim = F.round((F.col("file") % 100) / 100.0, 2)
    return f.select("file", scoring.immune(sim, F.col("hits"), F.col("file") % 6 == 0, F.col("file") % 10 == 0).alias("verdict"))


@query("SELECT CASE WHEN n <= 3 THEN 'low' WHEN n <= 8 THEN 'medium' ELSE 'high' END AS complexity, count(*) AS pages, sum(n)::BIGINT AS edges FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def migration_complexity(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(scoring.migration_complexity(F.col("n")).alias("complexity")).agg(F.count("*").alias("pages"), F.sum("n").alias("edges"))


@query("SELECT o_orderpriority AS dimension, o_orderstatus AS status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def migration_progress(spark, sf_dir):
    from pyspark.sql.window import Window

    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dimension"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dimension")), 6))


@query("SELECT mode, verdict, kill, CASE WHEN kill THEN 'blocked' WHEN mode = 'shadow' THEN 'log_only' WHEN mode = 'advisory' THEN 'advise' WHEN mode = 'guarded' AND verdict = 'allow' THEN 'apply_with_review' WHEN mode = 'autonomous' AND verdict = 'allow' THEN 'apply' ELSE 'hold' END AS action, n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'shadow' WHEN 1 THEN 'advisory' WHEN 2 THEN 'guarded' ELSE 'autonomous' END AS mode, CASE event_id % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' ELSE 'abstain' END AS verdict, event_id % 17 = 0 AS kill, count(*) AS n FROM events GROUP BY 1, 2, 3)")
def rollout_policy(spark, sf_dir):
    e = F.col("event_id")
    mode = F.when(e % 4 == 0, "shadow").when(e % 4 == 1, "advisory").when(e % 4 == 2, "guarded").otherwise("autonomous")
    verdict = F.when(e % 3 == 0, "allow").when(e % 3 == 1, "deny").otherwise("abstain")
    g = table(spark, sf_dir, "events").groupBy(mode.alias("mode"), verdict.alias("verdict"), (e % 17 == 0).alias("kill")).agg(F.count("*").alias("n"))
    return g.select("mode", "verdict", "kill", scoring.rollout(F.col("mode"), F.col("verdict"), F.col("kill")).alias("action"), "n")


@query("SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY 1, 2")
def review_tally(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("WITH r AS (SELECT user_id, round(sum((event_type = 'purchase')::INT)::DOUBLE / count(*), 6) AS c, round(sum((event_type = 'error')::INT)::DOUBLE / count(*), 6) AS x FROM events GROUP BY 1) SELECT user_id, round(least(greatest(0.7 * c - 0.5 * x + 0.3 * greatest(c - x, 0), 0), 1), 6) AS confidence FROM r")
def reconciliation_confidence(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("c"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("x"))
    return r.select("user_id", F.round(scoring.reconciliation_confidence(F.col("c"), F.col("x"), F.col("c") - F.col("x")), 6).alias("confidence"))

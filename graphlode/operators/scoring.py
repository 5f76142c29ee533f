"""Scores, policies and verdicts as column expressions over rows of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blast radius: component, weight, saturation (fixed values).
BLAST = [
    ("dependency", 0.35, 50.0),
    ("sql", 0.15, 10.0),
    ("state", 0.15, 10.0),
    ("handles", 0.05, 15.0),
    ("polymorphism", 0.10, 8.0),
    ("pagerank", 0.10, None),
    ("gis", 0.05, 5.0),
    ("script", 0.05, 5.0),
]
#: Decision gates and their reliability weights (fixed values).
GATES = {"extraction": 0.20, "safety": 0.15, "retrieval": 0.25, "immune": 0.10, "blast": 0.15, "ambiguity": 0.10, "coverage": 0.05, "runtime": 0.10}
#: Authority of evidence kinds (fixed values).
AUTHORITY = {
    "runtime": 1.0, "current_code": 0.95, "historical_code": 0.95, "requirement": 0.9, "documentation": 0.7, "history": 0.6,
    "derived_logic": 0.55, "memory": 0.45, "insight": 0.35, "similarity": 0.15,
}


def saturate(count: Column, most: float) -> Column:
    return F.least(10.0 * count.cast("double") / most, F.lit(10.0))


def blast_score(uncertainty: Column | None = None) -> Column:
    """Unrounded score from columns named like the components (``pagerank`` is a rank in 0..1)."""
    total = F.lit(0.0)
    for name, weight, most in BLAST:
        part = F.least(200.0 * F.col(name), F.lit(10.0)) if most is None else saturate(F.col(name), most)
        total = total + weight * part
    if uncertainty is not None:
        total = total + F.least(0.15 * uncertainty, F.lit(1.5))
    return F.least(total, F.lit(10.0))


def blast_radius(facts: DataFrame, key: str, uncertainty: Column | None = None) -> DataFrame:
    score = F.least(F.greatest(F.floor(F.col("raw") + 0.5), F.lit(1)), F.lit(10)).cast("long")
    band = F.when(F.col("score") <= 3, "low").when(F.col("score") <= 6, "medium").when(F.col("score") <= 8, "high").otherwise("critical")
    return facts.withColumn("raw", blast_score(uncertainty)).withColumn("score", score).select(key, "raw", "score", band.alias("band"))


def uncertainty(ui: Column, late: Column, sql: Column, sql_unknown: Column) -> Column:
    """0 to 1 each saturating at four findings; unknown SQL counts beside unresolved SQL."""
    unit = lambda c: F.least(c.cast("double") / 4.0, F.lit(1.0))
    return 0.35 * unit(ui) + 0.35 * unit(late) + 0.30 * (0.7 * unit(sql) + 0.3 * sql_unknown)


def safety_checks() -> dict[str, Column]:
    """Six checks over a request row; coverage of -1 is unknown and fails."""
    c = F.col
    return {
        "impact_ok": c("impact_confidence") >= 0.7,
        "coverage_ok": (c("test_coverage") >= 0.6),
        "clean_ok": c("anti_pattern_clear"),
        "dependents_ok": c("downstream_dependents") <= 50,
        "state_ok": ~c("touches_global_state") | (c("impact_confidence") >= 0.9),
        "database_ok": ~c("touches_database") | ((c("impact_confidence") >= 0.9) & (c("test_coverage") >= 0.8)),
    }


def risk_points() -> Column:
    c = F.col
    steps = lambda x, a, b, d: F.when(x <= a, 0).when(x <= b, 1).when(x <= d, 2).otherwise(3)
    points = steps(c("n_files"), 3, 10, 30) + steps(c("downstream_dependents"), 5, 20, 50)
    points = points + F.when(c("touches_global_state"), 2).otherwise(0) + F.when(c("touches_database"), 2).otherwise(0)
    return points + F.when(c("impact_confidence") < 0.5, 2).when(c("impact_confidence") < 0.7, 1).otherwise(0)


def evaluate_safety(requests: DataFrame, key: str) -> DataFrame:
    checks = safety_checks()
    passed = sum((F.when(x, 1).otherwise(0) for x in checks.values()), F.lit(0))
    risk = F.when(F.col("points") <= 2, "low").when(F.col("points") <= 5, "medium").when(F.col("points") <= 8, "high").otherwise("critical")
    rows = requests.withColumn("passed", passed).withColumn("points", risk_points())
    return rows.select(key, (F.col("passed") == len(checks)).alias("safe"), (F.col("passed") / float(len(checks))).alias("confidence"), F.col("points").cast("long").alias("points"), risk.alias("risk"))


def decide(rows: DataFrame, key: str) -> DataFrame:
    """Verdict over gate columns ``<gate>`` in (pass, fail, skip, missing) and ``<gate>_confidence``.

    Hard evidence that fails denies; missing evidence, uncertainty or too many skipped gates abstain.
    """
    c = F.col
    hard = (c("extraction") == "fail") | (c("safety") == "fail") | (c("retrieval") == "fail") | (c("immune") == "fail")
    missing = F.lit(False)
    failed = F.lit(False)
    skipped = F.lit(0)
    weight, value = F.lit(0.0), F.lit(0.0)
    for g, w in GATES.items():
        missing = missing | (c(g) == "missing")
        failed = failed | (c(g) == "fail")
        skipped = skipped + F.when(c(g) == "skip", 1).otherwise(0)
        on = c(g) != "skip"
        weight = weight + F.when(on, w).otherwise(0.0)
        value = value + F.when(on, w * c(f"{g}_confidence")).otherwise(0.0)
    enough = skipped <= F.floor(F.lit(len(GATES)) / 3)
    verdict = F.when(hard, "deny").when(missing | failed | ~enough, "abstain").otherwise("allow")
    interaction = F.when((c("safety") == "fail") & (c("blast") == "fail"), 0.10).otherwise(0.0)
    mean = value / F.nullif(weight, F.lit(0.0))
    confidence = F.least(F.greatest(F.coalesce(mean, F.lit(0.0)) - interaction, F.lit(0.0)), F.lit(1.0))
    return rows.select(key, verdict.alias("verdict"), confidence.alias("confidence"))


def decide_waves(items: DataFrame, wave: str) -> DataFrame:
    """Any deny denies a wave; more than three items over risk 5 abstain."""
    agg = items.groupBy(wave).agg(
        F.bool_or(F.col("verdict") == "deny").alias("denied"),
        F.bool_or(F.col("verdict") == "abstain").alias("unsure"),
        F.count_if(F.col("risk") > 5).alias("risky"),
        F.max("risk").alias("max_risk"),
        F.avg("confidence").alias("mean_confidence"),
        F.count("*").alias("items"),
    )
    verdict = F.when(F.col("denied"), "deny").when(F.col("unsure") | (F.col("risky") > 3), "abstain").otherwise("allow")
    return agg.select(wave, verdict.alias("verdict"), "max_risk", "mean_confidence", "risky", "items")


def reconciliation_confidence(confirmed: Column, contradicted: Column, delta: Column) -> Column:
    return F.least(F.greatest(0.7 * confirmed - 0.5 * contradicted + 0.3 * F.greatest(delta, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def rollout(mode: Column, verdict: Column, kill_switch: Column) -> Column:
    """What a verdict may do under a rollout mode."""
    return (
        F.when(kill_switch, "blocked")
        .when(mode == "shadow", "log_only")
        .when(mode == "advisory", "advise")
        .when((mode == "guarded") & (verdict == "allow"), "apply_with_review")
        .when((mode == "autonomous") & (verdict == "allow"), "apply")
        .otherwise("hold")
    )


def evidence_score(authority: Column, directness: Column, relevance: Column, corroboration: Column, age_days: Column) -> Column:
    return 0.40 * authority + 0.30 * directness + 0.15 * relevance + 0.10 * corroboration + 0.05 * F.pow(F.lit(0.5), age_days / 30.0)


def authority(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair)), kind), F.lit(0.15))


def weighted_confidence(signals: dict[str, float]) -> Column:
    """Mean of signal columns by weight; absent signals (null) count with neither."""
    weight, value = F.lit(0.0), F.lit(0.0)
    for name, w in signals.items():
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
        value = value + F.coalesce(w * F.col(name), F.lit(0.0))
    return F.coalesce(value / F.nullif(weight, F.lit(0.0)), F.lit(0.0))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def immune(similarity: Column, hits: Column, flagged: Column, destructive: Column, warn: float = 0.15, block: float = 0.8) -> Column:
    """The ladder from clean to warn to block."""
    blocks = (similarity > block) | (flagged & destructive & (similarity > warn))
    warns = (similarity > warn) | ((hits >= 3) & (similarity > warn / 2)) | (flagged & ((similarity > 0) | destructive))
    return F.when(blocks, "block").when(warns, "warn").otherwise("clean")


def trace_confidence(penalties: Column, fallback: Column) -> Column:
    return F.least(F.greatest(1.0 - penalties - fallback, F.lit(0.10)), F.lit(1.0))


def migration_complexity(n_edges: Column) -> Column:
    return F.when(n_edges <= 3, "low").when(n_edges <= 8, "medium").otherwise("high")


def threshold_findings(facts: DataFrame, key: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """Anti-patterns: name -> (measure, threshold).  Severe beyond twice the threshold."""
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(m).cast("double").alias("measure"), F.lit(float(t)).alias("threshold")) for n, (m, t) in rules.items())))
    severity = F.when(F.col("measure") > 2 * F.col("threshold"), "severe").otherwise("moderate")
    return facts.select(key, each).filter("measure > threshold").select(key, "pattern", "measure", severity.alias("severity"))

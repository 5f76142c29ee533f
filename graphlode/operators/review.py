"""Review gates over the added lines of a change.

A diff is a table (``change``, ``file``, ``line_no``, ``line``).  Every gate returns
(``gate``, ``change``, ``file``, ``line_no``, ``severity``, ``detail``), so gates are
put together by union and a verdict is an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.functions import paths as px
from graphlode.functions import text as tx
from graphlode.lineage import dealt

#: Secret kinds and their patterns (fixed values, as their issuers form them).
SECRETS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret": r"""(?i)\baws.{0,20}?(?:secret|key).{0,20}?['"\s:=]+["']?[A-Za-z0-9/+]{40}\b""",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "openai_key": r"\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}\b",
    "slack_token": r"\bxox(?:b-[0-9]+|p-[0-9]+-[0-9]+)-[0-9]+-[A-Za-z0-9]+\b",
    "stripe_key": r"\b[sr]k_live_[0-9A-Za-z]{24,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "credential": r"""(?i)(?:password|passwd|secret|token|api[_-]?key|auth[_-]?key)\b[^"'\n]{0,40}[:=]\s*["'][A-Za-z0-9_!@#$%^&*+/=-]{12,}["']""",
    "connection_string": r"(?i)\b(?:password|pwd)\s*=\s*[^;\s]{4,}",
}
DESTRUCTIVE = r"(?i)\b(?:drop\s+table|truncate\s+table|delete\s+from|rm\s+-rf)\b"
MUTATION = r"(?i)\b(?:insert\s+into|update\s+\w+\s+set|delete\s+from|submitchanges|executenonquery)\b"
AUDIT = r"(?i)\b(?:audit|auditlog|logchange|writelog)\w*"


def finding(rows: DataFrame, gate: str, severity, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    line = F.col("line_no") if "line_no" in rows.columns else F.lit(None)
    return rows.select(F.lit(gate).alias("gate"), "change", "file", line.cast("long").alias("line_no"), severity.alias("severity"), detail.alias("detail"))


def redact(text: Column) -> Column:
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def secrets(lines: DataFrame) -> DataFrame:
    """Every secret by kind, known by its fingerprint only."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("found")) for k, p in SECRETS.items()))
    rows = lines.select("change", "file", "line_no", F.inline(each)).select("change", "file", "line_no", "kind", F.explode("found").alias("secret"))
    return finding(rows, "secret_leakage", "critical", F.concat_ws(":", "kind", F.left(F.sha2("secret", 256), F.lit(12))))


def audit(lines: DataFrame, around: int = 5) -> DataFrame:
    """Database changes without an audit call nearby."""
    w = Window.partitionBy("change", "file").orderBy("line_no").rangeBetween(-around, around)
    seen = lines.withColumn("audited", F.max(F.col("line").rlike(AUDIT)).over(w))
    return finding(seen.filter(F.col("line").rlike(MUTATION) & ~F.col("audited")), "audit", "warning", F.trim("line"))


def repo_rules(lines: DataFrame, rules: DataFrame, listed: int = 500) -> DataFrame:
    """Machine-checkable rules (``rule``, ``pattern``, ``scope``, ``severity``).

    Up to ``listed`` rules are tested on each line in one pass; more are joined, and Spark broadcasts them if their size allows.
    """
    few = rules.select("rule", "pattern", "scope", "severity").limit(listed + 1).collect()
    if 0 < len(few) <= listed:
        each = [
            F.when(F.contains(F.lower("file"), F.lit(r.scope.lower())) & F.col("line").rlike(r.pattern), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.rule).alias("detail")))
            for r in few
            if r.scope is not None and r.pattern is not None
        ]
        if each:
            hits = lines.select("change", "file", "line_no", F.explode(F.array_compact(F.array(*each))).alias("hit"))
            return hits.select(F.lit("repo_rule").alias("gate"), "change", "file", "line_no", "hit.severity", "hit.detail")
    hits = lines.join(rules, F.contains(F.lower("file"), F.lower("scope")) & F.expr("line rlike pattern"))
    return hits.select(F.lit("repo_rule").alias("gate"), "change", "file", "line_no", "severity", F.col("rule").alias("detail"))


def immune(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Files flagged by reverts; critical beside destructive text."""
    rows = lines.join(flagged.select("file", "reverts"), "file").groupBy("change", "file").agg(F.bool_or(F.col("line").rlike(DESTRUCTIVE)).alias("destructive"), F.max("reverts").alias("reverts"))
    return finding(rows, "immune", F.when(F.col("destructive"), "critical").otherwise("warning"), F.concat(F.lit("reverts="), F.col("reverts").cast("string")))


def blast(changes: DataFrame, radius: DataFrame, least: int = 7) -> DataFrame:
    rows = changes.select("change", "file").distinct().join(radius, "file", "left")
    rows = rows.filter(F.col("score").isNull() | (F.col("score") >= least))
    return finding(rows, "blast_radius", F.when(F.col("score").isNull(), "advisory").when(F.col("score") >= 9, "critical").otherwise("warning"), F.coalesce(F.col("score").cast("string"), F.lit("unknown")))


def temporal(changes: DataFrame, pairs: DataFrame, least: int, most: int = 20) -> DataFrame:
    """Partners of changed files that the change leaves out."""
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "weight").unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "weight"))
    w = Window.partitionBy("file").orderBy(F.desc("weight"), "partner")
    strong = both.filter(F.col("weight") >= least).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most)
    held = changes.select("change", "file").distinct()
    rows = held.join(strong, "file").join(held.select("change", F.col("file").alias("partner")), ["change", "partner"], "left_anti")
    return finding(rows, "temporal", "warning", F.concat_ws(":", F.col("partner").cast("string"), F.col("weight").cast("string")))


def shared_state(changes: DataFrame, uses: DataFrame) -> DataFrame:
    """State keys (``file``, ``state``, ``access``) that files outside the change use too."""
    held = changes.select("change", "file").distinct()
    mine = held.join(uses.select("file", "state").distinct(), "file")
    others = uses.select("state", F.col("file").alias("other")).distinct()
    rows = mine.join(others, "state").filter("other != file").join(held.select("change", F.col("file").alias("other")), ["change", "other"], "left_anti")
    rows = rows.groupBy("change", "file", "state").agg(F.count("*").alias("others"))
    return finding(rows, "state", "advisory", F.concat_ws(":", F.col("state").cast("string"), F.col("others").cast("string")))


def anti_patterns(lines: DataFrame, patterns: DataFrame, least: int = 4) -> DataFrame:
    """Files whose added text holds most terms of an indexed anti-pattern (``pattern``, ``terms``).

    Terms are joined by equality and counted; files and patterns are never all paired.  Lines are
    shuffled once, by file; the patterns' terms go to every task, so a file's hits are counted where it is.
    """
    words = dealt(lines.select("change", "file", F.array_distinct(tx.words(F.col("line"))).alias("terms")), "file")
    have = words.select("change", "file", F.explode("terms").alias("term")).distinct()
    want = patterns.select("pattern", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    share = have.join(F.broadcast(want), "term").groupBy("change", "file", "pattern").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    rows = share.filter(F.col("hits") >= F.least(F.lit(least), F.col("n"))).withColumn("share", F.col("hits") / F.col("n"))
    return finding(rows.filter("share > 0.15"), "anti_pattern", F.when(F.col("share") > 0.8, "critical").otherwise("warning"), F.concat_ws(":", F.col("pattern").cast("string"), F.format_string("%.3f", "share")))


def test_coverage(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed sources whose coupled tests are not in the change."""
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("test")).unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("test")))
    tests = both.filter(px.is_test(F.col("test")) & ~px.is_test(F.col("file")))
    held = changes.select("change", "file").distinct()
    rows = held.join(tests, "file").join(held.select("change", F.col("file").alias("test")), ["change", "test"], "left_anti")
    return finding(rows, "test_coverage", "advisory", F.col("test"))


def new_files(added: DataFrame, known: DataFrame) -> DataFrame:
    """New files whose extension is not the usual one of their folder (``file``)."""
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    count = known.select(folder.alias("folder"), px.extension(F.col("file")).alias("ext")).groupBy("folder", "ext").agg(F.count("*").alias("n"))
    usual = count.groupBy("folder").agg(F.max_by("ext", F.struct("n", "ext")).alias("usual"), F.sum("n").alias("n"))
    rows = added.select("change", "file").distinct().withColumn("folder", folder).join(usual.filter("n >= 3"), "folder").filter(px.extension(F.col("file")) != F.col("usual"))
    return finding(rows, "new_file", "advisory", F.col("usual"))


def complexity(methods: DataFrame, most_branches: int = 15, most_parameters: int = 7) -> DataFrame:
    """Methods (``change``, ``file``, ``line_no``, ``name``, ``parameters``, ``body``) that are too branched or too wide."""
    rows = methods.withColumn("branches", tx.complexity(F.col("body"))).withColumn("width", F.when(F.trim("parameters") == "", 0).otherwise(F.size(F.split("parameters", ","))))
    rows = rows.filter((F.col("branches") > most_branches) | (F.col("width") > most_parameters))
    return finding(rows, "complexity", "warning", F.concat_ws(":", "name", F.col("branches").cast("string"), F.col("width").cast("string")))


def unwired(added: DataFrame, references: DataFrame) -> DataFrame:
    """Added functions (``name``) that nothing refers to (``target``)."""
    rows = added.join(references.select(F.col("target").alias("name")).distinct(), "name", "left_anti")
    return finding(rows, "unwired", "advisory", F.col("name"))


def guard_parity(endpoints: DataFrame) -> DataFrame:
    """New endpoints (``change``, ``file``, ``name``, ``is_new``, ``guards``) without a guard that all siblings of the file call."""
    old = endpoints.filter("NOT is_new")
    n = old.groupBy("file").agg(F.count("*").alias("siblings"))
    usual = old.select("file", F.explode(F.array_distinct("guards")).alias("guard")).groupBy("file", "guard").agg(F.count("*").alias("n")).join(n, "file").filter("n = siblings").select("file", "guard")
    new = endpoints.filter("is_new").join(usual, "file").filter(~F.expr("array_contains(guards, guard)"))
    return finding(new, "guard_parity", "warning", F.concat_ws(":", "name", "guard"))


def sync_contracts(changes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Files bound by a keep-in-sync comment (``file``, ``other``) of which one is changed without the other."""
    held = changes.select("change", "file").distinct()
    rows = held.join(contracts, "file").join(held.select("change", F.col("file").alias("other")), ["change", "other"], "left_anti")
    return finding(rows, "sync_contract", "warning", F.col("other"))


def co_added(changes: DataFrame, history: DataFrame, least: int = 3) -> DataFrame:
    """Families usually added with a family of this change (``change``, ``family``), by their share in history."""
    past = history.select(F.col("change").alias("past"), "family").distinct()
    n = past.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    pairs = past.join(past.toDF("past", "other"), "past").filter("family != other").groupBy("family", "other").agg(F.count("*").alias("together")).join(n, "family")
    pairs = pairs.withColumn("share", F.col("together") / F.col("n")).filter("share >= 0.4")
    held = changes.select("change", "family").distinct()
    rows = held.join(pairs, "family").join(held.select("change", F.col("family").alias("other")), ["change", "other"], "left_anti").withColumn("file", F.col("family").cast("string"))
    return finding(rows, "co_added_family", F.when(F.col("share") >= 0.6, "warning").otherwise("advisory"), F.concat_ws(":", F.col("other").cast("string"), F.format_string("%.3f", "share")))


def style(declared: DataFrame, known: DataFrame) -> DataFrame:
    """Declarations (``file``, ``name``) against the dominant casing of their file."""
    case = F.when(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"), "pascal").when(F.col("name").rlike("^[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$"), "camel").when(F.col("name").rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake").otherwise("other")
    count = known.withColumn("casing", case).groupBy("file", "casing").agg(F.count("*").alias("n"))
    usual = count.groupBy("file").agg(F.max_by("casing", F.struct("n", "casing")).alias("usual"), F.max("n").alias("top"), F.sum("n").alias("n")).filter("n >= 3 AND top * 10 >= n * 6")
    rows = declared.withColumn("casing", case).join(usual, "file").filter("casing != usual AND casing != 'other'")
    return finding(rows, "style", "advisory", F.concat_ws(":", "name", "usual"))


def conventions(added: DataFrame, known: DataFrame) -> DataFrame:
    """Added declarations without a comment where most of the file's have one (``documented``)."""
    usual = known.groupBy("file").agg(F.avg(F.col("documented").cast("double")).alias("share"), F.count("*").alias("n")).filter("n >= 3 AND share >= 0.6")
    return finding(added.filter("NOT documented").join(usual, "file"), "conventions", "advisory", F.col("name"))


def house_style(added: DataFrame, known: DataFrame) -> DataFrame:
    """Added markup classes (``folder``, ``css``) that no page of the folder uses."""
    rows = added.join(known.select("folder", "css").distinct(), ["folder", "css"], "left_anti")
    return finding(rows, "ui_house_style", "advisory", F.col("css"))


def product_intent(lines: DataFrame, intents: DataFrame) -> DataFrame:
    """Changes whose terms meet a written product intent (``pattern``, ``terms``)."""
    return anti_patterns(lines, intents).withColumn("gate", F.lit("product_intent")).withColumn("severity", F.lit("advisory"))


def verdict(findings: DataFrame) -> DataFrame:
    """Counts by severity and the badge of each change; ids are stable hashes."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    agg = findings.groupBy("change").agg(count("critical"), count("warning"), count("advisory"))
    return agg.withColumn("badge", F.when(F.col("critical") > 0, "red").when(F.col("warning") > 0, "yellow").otherwise("green"))


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_id", F.left(F.sha2(F.concat_ws("\u0000", "gate", F.col("file").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), "detail"), 256), F.lit(16)))

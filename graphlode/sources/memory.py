"""Notes as Markdown with front matter, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """``id``, ``kind``, ``tags``, ``body`` from files that start with a block between ``---`` lines."""
    raw = spark.read.text(root, wholetext=True)
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1))
    tags = F.filter(F.transform(F.split(F.regexp_replace(field("tags"), r"[\[\]]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    return raw.select(field("id").alias("id"), field("kind").alias("kind"), tags.alias("tags"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("body"))


def render_notes(notes: DataFrame) -> DataFrame:
    """``id`` and ``value``, the Markdown of each note."""
    return notes.select("id", F.concat(F.lit("---\nid: "), "id", F.lit("\nkind: "), "kind", F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n"), "body").alias("value"))


def rules_from_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Guidance lines (bullets that say must, never, always, avoid, prefer or do not) as rules known by their content."""
    line = F.explode(F.split(F.col(text), "\n"))
    rows = docs.select(key, line.alias("line")).filter(F.col("line").rlike(r"(?i)^\s*(?:[-*]|\d+\.)\s.*\b(?:must|never|always|avoid|prefer|do not)\b"))
    rule = F.trim(F.regexp_replace("line", r"^\s*(?:[-*]|\d+\.)\s*", ""))
    severity = F.when(F.lower(rule).rlike(r"\b(?:must|never)\b"), "blocker").when(F.lower(rule).rlike(r"\b(?:always|do not)\b"), "major").otherwise("minor")
    return rows.select(key, rule.alias("rule"), severity.alias("severity"), F.left(F.sha2(F.lower(rule), 256), F.lit(16)).alias("rule_id"))


def findings_from_export(exports: DataFrame, text: str) -> DataFrame:
    """Issues of analysers' exports (JSON with a list ``issues``): ``finding_id``, ``rule``, ``severity``, ``file``, ``line``, ``message``.

    A component's project prefix goes; equal findings are one row; text that is no such JSON has none.
    """
    schema = "struct<issues:array<struct<rule:string,severity:string,component:string,line:long,message:string>>>"
    rows = exports.select(F.explode(F.from_json(text, schema)["issues"]).alias("i")).filter("i.message IS NOT NULL")
    file = F.nullif(F.regexp_replace("i.component", r"^[^:]*:", ""), F.lit(""))
    rows = rows.select("i.rule", F.lower("i.severity").alias("severity"), file.alias("file"), "i.line", "i.message").distinct()
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule", "file", "line", "message"))
    return rows.select(F.left(F.sha2(F.concat_ws("\u0000", *parts), 256), F.lit(16)).alias("finding_id"), "rule", "severity", "file", "line", "message")


def promoted_rules(findings: DataFrame) -> DataFrame:
    """Grave findings with a file as repository rules: one a message and folder, whole messages, with how often it was found."""
    grave = findings.filter(F.col("severity").isin("blocker", "critical", "high") & F.col("file").isNotNull())
    scope = F.regexp_extract("file", r"^(.*/)[^/]*$", 1)
    return grave.groupBy(F.col("message").alias("rule"), scope.alias("scope")).agg(F.count("*").alias("findings"), F.min("file").alias("first_file"))


def verdicts(threads: DataFrame) -> DataFrame:
    """Review threads (``thread``, ``comments`` as JSON) to a verdict from the last answer."""
    schema = "array<struct<author:string,body:string,at:long>>"
    rows = threads.select("thread", F.sort_array(F.transform(F.from_json("comments", schema), lambda c: F.struct(c["at"].alias("at"), c["body"].alias("body")))).alias("c"))
    last = F.lower(F.element_at("c", -1)["body"])
    kind = F.when(last.rlike(r"\b(?:fixed|done|resolved|addressed)\b"), "accepted").when(last.rlike(r"won'?t fix|by design|not a bug|disagree|false positive"), "rejected").otherwise("open")
    return rows.filter(F.size("c") > 0).select("thread", F.element_at("c", 1)["body"].alias("finding"), F.when(F.size("c") == 1, "open").otherwise(kind).alias("verdict"), F.size("c").cast("long").alias("comments"))

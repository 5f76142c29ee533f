"""Review gates: documents stand for changed files, their lines for added lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import retrieval, review, temporal
from graphlode.plans import query
from graphlode.plans.history import PAIRS, files

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents)"
KEYS = list(review.SECRETS.items())
SQL_KEYS = [(k, p.replace("'", "''")) for k, p in KEYS]


def lines(spark, sf_dir):
    rows = retrieval.lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select(F.lit(1).alias("change"), F.col("doc_id").alias("file"), "line_no", "line")


@query(
    f"WITH {LINES}, s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, unnest(regexp_extract_all(line, '{p}')) AS secret FROM l" for k, p in SQL_KEYS)
    + ") SELECT doc_id AS file, line_no, kind || ':' || left(sha256(secret), 12) AS detail FROM s"
)
def secret_scan(spark, sf_dir):
    return review.secrets(lines(spark, sf_dir)).select("file", "line_no", "detail")


EDIT = "SELECT DISTINCT l_orderkey AS change, l_partkey AS file FROM lineitem WHERE l_orderkey BETWEEN 100 AND 140"


def changes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_orderkey BETWEEN 100 AND 140").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("file")).distinct()


@query(
    f"""WITH {PAIRS}, c AS ({EDIT}), d AS (SELECT file_a AS file, file_b AS partner, weight FROM pairs WHERE weight >= 2 UNION ALL SELECT file_b, file_a, weight FROM pairs WHERE weight >= 2),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY weight DESC, partner) AS t FROM d) WHERE t <= 20)
SELECT c.change, c.file, k.partner || ':' || k.weight AS detail FROM c JOIN k ON k.file = c.file WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.file = k.partner)"""
)
def temporal_gate(spark, sf_dir):
    return review.temporal(changes(spark, sf_dir), temporal.cochanges(files(spark, sf_dir)), 2).select("change", "file", "detail")


@query(
    f"""WITH c AS ({EDIT}), u AS (SELECT DISTINCT l_partkey AS file, l_suppkey % 40 AS state FROM lineitem)
SELECT c.change, c.file, m.state || ':' || count(*) AS detail FROM c JOIN u m ON m.file = c.file JOIN u o ON o.state = m.state AND o.file <> m.file
WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.file = o.file) GROUP BY c.change, c.file, m.state"""
)
def state_gate(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), (F.col("l_suppkey") % 40).alias("state")).distinct()
    return review.shared_state(changes(spark, sf_dir), uses).select("change", "file", "detail")


@query(
    f"""WITH c AS ({EDIT}), r AS (SELECT p_partkey AS file, p_size % 11 AS score FROM part WHERE p_partkey % 4 <> 0)
SELECT c.change, c.file, CASE WHEN score IS NULL THEN 'advisory' WHEN score >= 9 THEN 'critical' ELSE 'warning' END AS severity, coalesce(CAST(score AS VARCHAR), 'unknown') AS detail FROM c LEFT JOIN r ON r.file = c.file WHERE score IS NULL OR score >= 7"""
)
def blast_gate(spark, sf_dir):
    radius = table(spark, sf_dir, "part").filter("p_partkey % 4 != 0").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 11).alias("score"))
    return review.blast(changes(spark, sf_dir), radius).select("change", "file", "severity", "detail")


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS past, o_orderpriority AS family FROM orders WHERE o_custkey NOT BETWEEN 200 AND 260), n AS (SELECT family, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 3),
 s AS (SELECT a.family, b.family AS other, count(*)::DOUBLE / n.n AS share FROM p a JOIN p b ON a.past = b.past AND a.family <> b.family JOIN n ON n.family = a.family GROUP BY 1, 2, n.n HAVING count(*)::DOUBLE / n.n >= 0.4),
 c AS (SELECT DISTINCT o_custkey AS change, o_orderpriority AS family FROM orders WHERE o_custkey BETWEEN 200 AND 260)
SELECT c.change, c.family AS file, CASE WHEN share >= 0.6 THEN 'warning' ELSE 'advisory' END AS severity, s.other AS detail FROM c JOIN s ON s.family = c.family WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.family = s.other)"""
)
def co_added_family_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("change"), F.col("o_orderpriority").alias("family"))
    out = review.co_added(o.filter("change BETWEEN 200 AND 260").distinct(), o.filter("change NOT BETWEEN 200 AND 260"))
    return out.select("change", "file", "severity", F.regexp_extract("detail", r"^(.*):[^:]*$", 1).alias("detail"))


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS change, l_partkey AS file FROM lineitem WHERE l_orderkey BETWEEN 100 AND 140), k AS (SELECT p_partkey AS file, p_partkey + 1 AS other FROM part WHERE p_partkey % 2 = 0)
SELECT c.change, c.file, k.other AS detail FROM c JOIN k ON k.file = c.file WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.file = k.other)"""
)
def sync_contract_gate(spark, sf_dir):
    contracts = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("file"), (F.col("p_partkey") + 1).alias("other"))
    return review.sync_contracts(changes(spark, sf_dir), contracts).select("change", "file", "detail")


@query(
    """WITH h AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
 w AS (SELECT item_id AS pattern, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS n, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark),
 s AS (SELECT doc_id, pattern, count(*) AS hits, min(n) AS n FROM h JOIN w ON h.term = w.term GROUP BY 1, 2)
SELECT doc_id AS file, pattern, CASE WHEN hits::DOUBLE / n > 0.8 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE hits >= least(4, n) AND hits::DOUBLE / n > 0.15"""
)
def anti_pattern_gate(spark, sf_dir):
    from graphlode.functions import text as tx

    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern"), tx.words(F.col("text")).alias("terms"))
    out = review.anti_patterns(lines(spark, sf_dir), patterns)
    return out.select("file", F.regexp_extract("detail", r"^(\d+):", 1).cast("long").alias("pattern"), "severity")


@query(
    f"""WITH {LINES}, f AS (SELECT doc_id % 100 AS change, 'warning' AS severity FROM l WHERE regexp_matches(line, '(?i)licensed under') UNION ALL SELECT doc_id % 100, 'advisory' FROM l WHERE regexp_matches(line, '(?i)rights reserved'))
SELECT change, 0::BIGINT AS critical, sum((severity = 'warning')::INT)::BIGINT AS warning, sum((severity = 'advisory')::INT)::BIGINT AS advisory, CASE WHEN sum((severity = 'warning')::INT) > 0 THEN 'yellow' ELSE 'green' END AS badge FROM f GROUP BY 1"""
)
def repo_rule_verdict(spark, sf_dir):
    """Rules on lines, put together to a badge per change."""
    rules = spark.createDataFrame([("licence", "(?i)licensed under", "", "warning"), ("rights", "(?i)rights reserved", "", "advisory")], "rule string, pattern string, scope string, severity string")
    rows = lines(spark, sf_dir).select((F.col("file") % 100).alias("change"), F.col("file").cast("string").alias("file"), "line_no", "line")
    return review.verdict(review.repo_rules(rows, rules))


@query(
    f"WITH {LINES} SELECT doc_id AS file, line_no, "
    + "regexp_replace(" * len(SQL_KEYS) + "line" + "".join(f", '{p}', '[{k}]', 'g')" for k, p in SQL_KEYS)
    + " AS line FROM l WHERE " + " OR ".join(f"regexp_matches(line, '{p}')" for _, p in SQL_KEYS)
)
def redacted_lines(spark, sf_dir):
    held = F.lit(False)
    for _, p in KEYS:
        held = held | F.col("line").rlike(p)
    rows = lines(spark, sf_dir).filter(held)
    return rows.select("file", "line_no", review.redact(F.col("line")).alias("line"))

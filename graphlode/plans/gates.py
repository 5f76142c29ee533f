"""Further review gates over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import review
from graphlode.plans import query

ADDED = """a AS (SELECT l_orderkey AS change, 'f' || l_suppkey AS file, l_linenumber::BIGINT AS line_no, CASE WHEN l_partkey % 11 = 0 THEN 'DELETE FROM t' WHEN l_partkey % 11 = 1 THEN 'db.SubmitChanges()' WHEN l_partkey % 11 = 2 THEN 'WriteLog("x")' ELSE 'x = ' || l_partkey END AS line FROM lineitem)"""


def s(c):
    return c.cast("string")


def added(spark, sf_dir):
    p = F.col("l_partkey") % 11
    line = F.when(p == 0, "DELETE FROM t").when(p == 1, "db.SubmitChanges()").when(p == 2, 'WriteLog("x")').otherwise(F.concat(F.lit("x = "), s(F.col("l_partkey"))))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change"), F.concat(F.lit("f"), s(F.col("l_suppkey"))).alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), line.alias("line"))


@query(f"WITH {ADDED}, r AS (SELECT 'f' || s_suppkey AS file, s_nationkey AS reverts FROM supplier WHERE s_nationkey > 15) SELECT change, a.file, CASE WHEN bool_or(line = 'DELETE FROM t') THEN 'critical' ELSE 'warning' END AS severity, 'reverts=' || max(reverts) AS detail FROM a JOIN r ON r.file = a.file GROUP BY 1, 2")
def immune_gate(spark, sf_dir):
    flagged = table(spark, sf_dir, "supplier").filter("s_nationkey > 15").select(F.concat(F.lit("f"), s(F.col("s_suppkey"))).alias("file"), F.col("s_nationkey").alias("reverts"))
    return review.immune(added(spark, sf_dir), flagged).select("change", "file", "severity", "detail")


@query(
    f"""WITH {ADDED}, w AS (SELECT *, bool_or(line LIKE 'WriteLog%') OVER (PARTITION BY change, file ORDER BY line_no RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS audited FROM a)
SELECT change, file, line_no, line AS detail FROM w WHERE line IN ('DELETE FROM t', 'db.SubmitChanges()') AND NOT audited"""
)
def audit_gate(spark, sf_dir):
    return review.audit(added(spark, sf_dir)).select("change", "file", "line_no", "detail")


@query(
    """WITH k AS (SELECT 'm' || p_size % 8 AS folder, CASE WHEN p_partkey % 3 = 0 THEN 'vb' ELSE 'aspx' END AS ext FROM part), n AS (SELECT folder, ext, count(*) AS n FROM k GROUP BY 1, 2), u AS (SELECT folder, max_by(ext, n * 10 + length(ext)) AS usual, sum(n) AS n FROM n GROUP BY 1 HAVING sum(n) >= 3),
 c AS (SELECT DISTINCT l_orderkey AS change, 'm' || l_suppkey % 10 AS folder, l_partkey AS k, CASE WHEN l_partkey % 5 = 0 THEN 'vb' ELSE 'aspx' END AS ext FROM lineitem)
SELECT change, c.folder || '/F' || k || '.' || ext AS file, usual AS detail FROM c JOIN u ON u.folder = c.folder WHERE ext <> usual"""
)
def new_file_gate(spark, sf_dir):
    name = lambda m, key, ext: F.concat(F.lit("m"), s(m), F.lit("/F"), s(key), ext)
    known = table(spark, sf_dir, "part").select(name(F.col("p_size") % 8, F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, ".vb").otherwise(".aspx")).alias("file"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change"), name(F.col("l_suppkey") % 10, F.col("l_partkey"), F.when(F.col("l_partkey") % 5 == 0, ".vb").otherwise(".aspx")).alias("file"))
    return review.new_files(new, known).select("change", "file", "detail")


@query(
    """WITH p AS (SELECT DISTINCT 'src/f' || l_partkey % 200 || '.vb' AS file, 'tests/t' || l_suppkey % 20 || '.vb' AS test FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS change, 'src/f' || l_partkey % 200 || '.vb' AS file FROM lineitem WHERE l_orderkey % 20 = 0 UNION SELECT DISTINCT l_orderkey, 'tests/t' || l_suppkey % 20 || '.vb' FROM lineitem WHERE l_orderkey % 20 = 0)
SELECT c.change, c.file, p.test AS detail FROM c JOIN p ON p.file = c.file WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.change = c.change AND x.file = p.test)"""
)
def test_coverage_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    src = F.concat(F.lit("src/f"), s(F.col("l_partkey") % 200), F.lit(".vb"))
    test = F.concat(F.lit("tests/t"), s(F.col("l_suppkey") % 20), F.lit(".vb"))
    edits = li.filter("l_orderkey % 20 = 0")  # every twentieth change is under review
    changes = edits.select(F.col("l_orderkey").alias("change"), src.alias("file")).unionByName(edits.select(F.col("l_orderkey").alias("change"), test.alias("file")))
    return review.test_coverage(changes, li.select(test.alias("file_a"), src.alias("file_b")).distinct()).select("change", "file", "detail")


@query(
    """WITH e AS (SELECT s_suppkey AS k, 'f' || s_nationkey AS file, 'e' || s_suppkey AS name, s_suppkey % 5 = 0 AS is_new, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN ['login'] WHEN s_suppkey % 7 = 0 THEN ['login', 'role'] ELSE ['login', 'csrf'] END AS guards FROM supplier),
 o AS (SELECT file, count(*) AS n FROM e WHERE NOT is_new GROUP BY 1), u AS (SELECT x.file, guard FROM (SELECT file, unnest(guards) AS guard FROM e WHERE NOT is_new) x JOIN o ON o.file = x.file GROUP BY 1, 2, o.n HAVING count(*) = o.n)
SELECT e.file, e.name || ':' || guard AS detail FROM e JOIN u ON u.file = e.file WHERE is_new AND NOT list_contains(guards, guard)"""
)
def guard_parity_gate(spark, sf_dir):
    k = F.col("s_suppkey")
    two = lambda a, b: F.array(F.lit(a), F.lit(b))
    guards = F.when((k % 5 == 0) & (k % 2 == 0), F.array(F.lit("login"))).when(k % 7 == 0, two("login", "role")).otherwise(two("login", "csrf"))
    e = table(spark, sf_dir, "supplier").select(F.lit(1).alias("change"), F.concat(F.lit("f"), s(F.col("s_nationkey"))).alias("file"), F.concat(F.lit("e"), s(k)).alias("name"), (k % 5 == 0).alias("is_new"), guards.alias("guards"))
    return review.guard_parity(e).select("file", "detail")


@query("SELECT 'f' || p_size AS file, 'fn' || p_partkey AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unwired_gate(spark, sf_dir):
    new = table(spark, sf_dir, "part").select(F.lit(1).alias("change"), F.concat(F.lit("f"), s(F.col("p_size"))).alias("file"), F.concat(F.lit("fn"), s(F.col("p_partkey"))).alias("name"))
    return review.unwired(new, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("fn"), s(F.col("l_partkey"))).alias("target"))).select("file", "detail")


@query(
    """WITH m AS (SELECT c_custkey AS k, c_custkey % 25 AS branches, c_nationkey % 10 AS width FROM customer)
SELECT k AS line_no, 'm' || k || ':' || (1 + branches) || ':' || width AS detail FROM m WHERE 1 + branches > 15 OR width > 7"""
)
def complexity_gate(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 10
    body = F.repeat(F.lit("If a Then b\n"), (k % 25).cast("int"))
    names = F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("p"), s(i))), ", "))
    m = table(spark, sf_dir, "customer").select(F.lit(1).alias("change"), F.lit("f").alias("file"), k.alias("line_no"), F.concat(F.lit("m"), s(k)).alias("name"), names.alias("parameters"), body.alias("body"))
    return review.complexity(m).select("line_no", "detail")


@query(
    """WITH d AS (SELECT 'f' || p_size % 20 AS file, CASE WHEN p_partkey % 6 = 0 THEN 'get_item' || chr(97 + (p_partkey % 26)::INT) WHEN p_partkey % 6 = 1 AND p_size % 20 < 5 THEN 'getItem' ELSE 'GetItem' || p_partkey END AS name, p_partkey % 4 = 0 AS is_new FROM part),
 k AS (SELECT file, CASE WHEN regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') THEN 'pascal' WHEN regexp_matches(name, '^[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$') THEN 'camel' WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake' ELSE 'other' END AS casing, name, is_new FROM d),
 n AS (SELECT file, casing, count(*) AS n FROM k WHERE NOT is_new GROUP BY 1, 2), u AS (SELECT file, max_by(casing, n * 100 + ascii(casing) - 96) AS usual FROM n GROUP BY 1 HAVING sum(n) >= 3 AND max(n) * 10 >= sum(n) * 6)
SELECT k.file, name || ':' || usual AS detail FROM k JOIN u ON u.file = k.file WHERE is_new AND casing <> usual AND casing <> 'other'"""
)
def style_gate(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size") % 20
    name = F.when(k % 6 == 0, F.concat(F.lit("get_item"), F.char(97 + k % 26))).when((k % 6 == 1) & (z < 5), "getItem").otherwise(F.concat(F.lit("GetItem"), s(k)))
    d = table(spark, sf_dir, "part").select(F.lit(1).alias("change"), F.concat(F.lit("f"), s(z)).alias("file"), name.alias("name"), (k % 4 == 0).alias("is_new"))
    return review.style(d.filter("is_new"), d.filter("NOT is_new")).select("file", "detail")


@query(
    """WITH k AS (SELECT 'f' || p_size AS file, 'n' || p_partkey AS name, p_partkey % 4 <> 0 OR p_size > 40 AS documented, p_partkey % 5 = 0 AS is_new FROM part), u AS (SELECT file FROM k WHERE NOT is_new GROUP BY 1 HAVING count(*) >= 3 AND avg(documented::INT) >= 0.6)
SELECT k.file, name AS detail FROM k JOIN u ON u.file = k.file WHERE is_new AND NOT documented"""
)
def conventions_gate(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(F.lit(1).alias("change"), F.concat(F.lit("f"), s(F.col("p_size"))).alias("file"), F.concat(F.lit("n"), s(k)).alias("name"), ((k % 4 != 0) | (F.col("p_size") > 40)).alias("documented"), (k % 5 == 0).alias("is_new"))
    return review.conventions(d.filter("is_new"), d.filter("NOT is_new")).select("file", "detail")


@query("WITH k AS (SELECT DISTINCT p_brand AS folder, 'c' || p_size AS css FROM part WHERE p_partkey % 3 <> 0) SELECT p_partkey AS page, 'c' || p_size AS detail FROM part WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.folder = p_brand AND k.css = 'c' || p_size)")
def house_style_gate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("change"), F.col("p_partkey").alias("file"), F.col("p_brand").alias("folder"), F.concat(F.lit("c"), s(F.col("p_size"))).alias("css"))
    out = review.house_style(p.filter("file % 3 = 0"), p.filter("file % 3 != 0"))
    return out.select(F.col("file").alias("page"), "detail")


@query(
    """WITH h AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM conversations), w AS (SELECT item_id AS pattern, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS n, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark),
 x AS (SELECT conv_id, pattern, count(*) AS hits, min(n) AS n FROM h JOIN w ON h.term = w.term GROUP BY 1, 2) SELECT conv_id AS change, pattern, 'advisory' AS severity FROM x WHERE hits >= least(4, n) AND hits::DOUBLE / n > 0.15"""
)
def product_intent_gate(spark, sf_dir):
    from graphlode.functions import text as tx

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("change"), F.lit("f").alias("file"), F.col("text").alias("line"))
    intents = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern"), tx.words(F.col("text")).alias("terms"))
    return review.product_intent(rows, intents).select("change", F.regexp_extract("detail", r"^(\d+):", 1).cast("long").alias("pattern"), "severity")

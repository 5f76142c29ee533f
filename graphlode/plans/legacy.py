"""Page scripts, classic pages, controls, slices, stories, findings and literal search over the tables, whose columns are put into code."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import legacy, planning, retrieval, temporal
from graphlode.plans import query
from graphlode.plans.history import PAIRS, files
from graphlode.sources import memory


def pages(spark, sf_dir, content: str):
    """The parts as files with some code in which ``{column}`` stands for a value."""
    pieces = [F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(content.replace("}", "{").split("{"))]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(*pieces).alias("content"))


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, * FROM part) SELECT path, 'fetch' AS kind, '/api/' || p_brand AS name FROM p UNION SELECT path, 'postback', p_type FROM p UNION SELECT path, 'page_method', 'Get' || p_size FROM p
UNION SELECT path, 'element', 'e' || p_size FROM p UNION SELECT path, 'xhr', '/x/' || p_partkey FROM p UNION SELECT path, 'selector', 'ctl_' || p_size FROM p"""
)
def script_bridge(spark, sf_dir):
    code = """fetch('/api/{p_brand}'); fetch("/api/{p_brand}"); __doPostBack('{p_type}', ''); PageMethods.Get{p_size}(1); document.getElementById('e{p_size}').x = 1; r.open('GET', '/x/{p_partkey}'); $("[id$='ctl_{p_size}']").hide();"""
    return legacy.bridge(pages(spark, sf_dir, code))


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, * FROM part) SELECT path, 'leaflet' AS library, 'class' AS kind, 'tileLayer' AS name, 2::BIGINT AS n FROM p UNION ALL SELECT path, 'leaflet', 'tiles', 'http://t/' || p_size, 2 FROM p
UNION ALL SELECT path, 'google_maps', 'class', 'Marker', 1 FROM p UNION ALL SELECT path, 'settings', 'zoom', CAST(p_size AS VARCHAR), 1 FROM p UNION ALL SELECT path, 'settings', 'key', left(sha256('abcdefghijklmnopqrst' || p_partkey), 12), 1 FROM p"""
)
def map_inventory(spark, sf_dir):
    code = "L.tileLayer('http://t/{p_size}'); L.tileLayer('http://t/{p_size}'); new google.maps.Marker(m); o = {{zoom: {p_size}, apiKey: 'abcdefghijklmnopqrst{p_partkey}'"
    return legacy.map_parts(pages(spark, sf_dir, code.replace("{{", "")))


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, * FROM part) SELECT path, 'function' AS kind, 'Do' || p_size AS name FROM p UNION SELECT path, 'state_write', 'k' || p_size FROM p UNION SELECT path, 'state_read', 'r' || p_size FROM p UNION SELECT path, 'request', p_type FROM p
UNION SELECT path, 'redirect', p_partkey || '.asp' FROM p UNION SELECT path, 'include', p_brand || '.inc' FROM p UNION SELECT path, 'sql', 'SELECT a FROM T' || p_size || ' JOIN u ON x' FROM p UNION SELECT path, 'table', 't' || p_size FROM p UNION SELECT path, 'table', 'u' FROM p"""
)
def classic_pages(spark, sf_dir):
    code = """<!--#include file="{p_brand}.inc"--><%\nSub Do{p_size}(a)\nSession("k{p_size}") = Session("r{p_size}") & Request.Form("{p_type}")\nSet r = c.Execute("SELECT a FROM T{p_size} JOIN u ON x")\nResponse.Redirect "{p_partkey}.asp"\n%> Session("markup") """
    return legacy.classic(pages(spark, sf_dir, code))


@query(
    """WITH u AS (SELECT p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'GridView' WHEN 1 THEN 'TextBox' WHEN 2 THEN 'Repeater' ELSE 'Odd' END AS control FROM part)
SELECT control, count(*) AS uses, count(DISTINCT path) AS pages, CASE control WHEN 'GridView' THEN 'QuickGrid' WHEN 'TextBox' THEN 'InputText' WHEN 'Repeater' THEN 'loop with template' END AS blazor, CASE control WHEN 'GridView' THEN 4 WHEN 'TextBox' THEN 1 WHEN 'Repeater' THEN 2 END AS effort FROM u GROUP BY 1"""
)
def control_targets(spark, sf_dir):
    size = F.col("p_size") % 4
    name = F.when(size == 0, "GridView").when(size == 1, "TextBox").when(size == 2, "Repeater").otherwise("Odd")
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit('<asp:'), name, F.lit(' runat="server">')).alias("content"))
    return legacy.control_targets(held).select("control", "uses", "pages", "blazor", "effort")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 1000 AS dst, CASE l_linenumber % 4 WHEN 0 THEN 'contains' WHEN 1 THEN 'reads_state' WHEN 2 THEN 'queries' ELSE 'links' END AS kind FROM lineitem WHERE l_suppkey % 7 <> 3),
 r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE kind = 'contains' AND dst % 7 <> 3 AND depth < 2),
 m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)
SELECT CASE kind WHEN 'contains' THEN 'component' WHEN 'reads_state' THEN 'state' WHEN 'queries' THEN 'database' ELSE 'other' END AS class, dst AS node, (min(depth) + 1)::INTEGER AS depth FROM m JOIN e ON src = node GROUP BY 1, 2"""
)
def migration_slice(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "contains").when(n == 1, "reads_state").when(n == 2, "queries").otherwise("links")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("dst"), kind.alias("kind"))
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("dead", F.col("node") % 7 == 3)
    return legacy.migration_slice(edges, ends, 1, ["contains"], {"contains": "component", "reads_state": "state", "queries": "database"}, 2)


@query(
    """WITH c AS (SELECT DISTINCT 't' || p_size % 5 AS t, 'c' || p_partkey % 6 AS a, 'c' || p_partkey % 5 AS b FROM part)
SELECT t AS table_name, a, b FROM c WHERE NOT ((a = 'c1' AND b = 'c2') OR (a = 'c2' AND b = 'c1') OR (a = 'c3' AND b = 'c4' AND t = 't1') OR (a = 'c4' AND b = 'c3' AND t = 't1'))"""
)
def index_coverage(spark, sf_dir):
    """Pairs of columns compared for equality that no index begins with, in any order."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), F.col("p_size") % 5).alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey") % 6).alias("a"), F.concat(F.lit("c"), F.col("p_partkey") % 5).alias("b")).distinct()
    wanted = p.withColumn("equals", F.array("a", "b")).withColumn("then", F.array().cast("array<string>"))
    rows = [(f"t{i}", ["c2", "c1", "c0"]) for i in range(5)] + [("t1", ["c3", "c4"])]
    return legacy.uncovered(wanted, spark.createDataFrame(rows, "table_name string, columns array<string>")).select("table_name", "a", "b")


STORY = "As an admin I would like to have rings and bolts required"


@query(
    f"""WITH {PAIRS}, s AS (SELECT * FROM (VALUES ('rings', 'ring'), ('bolts', 'bolt'), ('required', 'requir')) t(arm, stem)),
 f AS (SELECT arm, p_partkey AS item, p_brand, CASE WHEN lower(p_name) = arm THEN 3 WHEN regexp_matches(lower(p_name), '(^|[^a-z])' || stem) THEN 2 WHEN contains(lower(p_name), stem) THEN 1 ELSE 0 END AS fit FROM part, s),
 k AS (SELECT arm, item, fit::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY arm, p_brand ORDER BY fit DESC, item) AS turn FROM f WHERE fit > 0) WHERE turn <= 5),
 b2 AS (SELECT file_a, file_b, weight FROM pairs UNION ALL SELECT file_b, file_a, weight FROM pairs)
SELECT arm, item, score FROM k UNION ALL SELECT 'coupled', file_b, sum(weight)::DOUBLE FROM b2 WHERE file_a IN (SELECT item FROM k) AND file_b NOT IN (SELECT item FROM k) GROUP BY 2"""
)
def story_plan(spark, sf_dir):
    concepts = planning.story_concepts(STORY)
    return planning.story_plan(table(spark, sf_dir, "part"), concepts, "p_partkey", "p_brand", "p_name", temporal.cochanges(files(spark, sf_dir)))


EXPORT = """x AS (SELECT DISTINCT 'r' || p_size AS rule, CASE p_partkey % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'critical' ELSE 'minor' END AS severity, 'src/' || p_type || '/f' || p_size || '.cs' AS file, p_partkey % 50 AS line, 'Mend ' || p_name AS message FROM part)"""


def issues(spark, sf_dir):
    n = F.col("p_partkey") % 3
    issue = F.struct(
        F.concat(F.lit("r"), "p_size").alias("rule"), F.when(n == 0, "BLOCKER").when(n == 1, "CRITICAL").otherwise("MINOR").alias("severity"), F.concat(F.lit("proj:src/"), "p_type", F.lit("/f"), "p_size", F.lit(".cs")).alias("component"),
        (F.col("p_partkey") % 50).alias("line"), F.concat(F.lit("Mend "), "p_name").alias("message"),
    )
    return table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(issue).alias("issues"))).alias("export"))


@query(f"WITH {EXPORT} SELECT left(sha256(rule || chr(0) || file || chr(0) || line || chr(0) || message), 16) AS finding_id, rule, severity, file, line, message FROM x")
def ingested_findings(spark, sf_dir):
    return memory.findings_from_export(issues(spark, sf_dir), "export")


@query(f"WITH {EXPORT} SELECT message AS rule, regexp_extract(file, '^(.*/)[^/]*$', 1) AS scope, count(*) AS findings, min(file) AS first_file FROM x WHERE severity <> 'minor' GROUP BY 1, 2")
def promoted_rules(spark, sf_dir):
    return memory.promoted_rules(memory.findings_from_export(issues(spark, sf_dir), "export"))


def _literal(mode: str) -> str:
    """Words of the query 'the License' with BM25; 'License' also as a substring, by its trigrams."""
    grams = ["Lic", "ice", "cen", "ens", "nse"]
    idf = lambda df: f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5))"
    word = lambda w: f"CASE WHEN {w} > 0 THEN {idf('d' + w)} * {w} * 2.2 / ({w} + 1.2 * (0.25 + 0.75 * words / mw)) ELSE 0 END"
    part = f"CASE WHEN s > 0 THEN ({' + '.join(idf('d' + g) for g in grams)}) * s * 2.2 / (s + 1.2 * (0.25 + 0.75 * grams / mg)) ELSE 0 END"
    score, wanted = {
        "loose": (f"{word('the')} + {word('license')} + 0.1 * {part}", "the > 0 OR license > 0 OR s > 0"),
        "strict": (f"{word('the')} + {word('license')} + 0.1 * {part}", "the > 0 AND (license > 0 OR s > 0)"),
        "regex": (part, "s > 0"),
    }[mode]
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
 c AS (SELECT doc_id, len(w) AS words, greatest(length(body) - 2, 0) AS grams, len(list_filter(w, lambda x: x = 'the')) AS the, len(list_filter(w, lambda x: x = 'license')) AS license, (length(body) - length(replace(body, 'License', ''))) // 7 AS s, {', '.join(f"contains(body, '{g}') AS {g}" for g in grams)} FROM t),
 st AS (SELECT count(*) AS n, avg(words::DOUBLE) AS mw, avg(grams::DOUBLE) AS mg, count(*) FILTER (WHERE the > 0) AS dthe, count(*) FILTER (WHERE license > 0) AS dlicense, {', '.join(f"count(*) FILTER (WHERE {g}) AS d{g}" for g in grams)} FROM c)
SELECT doc_id, round(({score})::DOUBLE, 6) AS score FROM c, st WHERE {wanted}"""


def literal(spark, sf_dir, text, mode):
    return retrieval.literal_search(table(spark, sf_dir, "documents"), "doc_id", "text", text, mode).withColumn("score", F.round("score", 6))


@query(_literal("loose"))
def literal_loose(spark, sf_dir):
    return literal(spark, sf_dir, "the License", "loose")


@query(_literal("strict"))
def literal_strict(spark, sf_dir):
    return literal(spark, sf_dir, "the (License)", "strict")


@query(_literal("regex"))
def literal_trigrams(spark, sf_dir):
    return literal(spark, sf_dir, "License", "regex")

"""Index lookups, flows and resolution over the tables, which stand for code as FIXTURES says."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.functions import paths as px
from graphlode.functions import text as tx
from graphlode.lineage import shared_dir, table
from graphlode.operators import flows, graph, index, planning, resolve, retrieval
from graphlode.plans import query
from graphlode.plans.retrieval import TERMS, _bm25


def s(c):
    return c.cast("string")


def folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/graphlode/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_bm25()} SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def postings_search(spark, sf_dir):
    """BM25 from a written index: only the terms' buckets are read."""
    docs, at = table(spark, sf_dir, "documents"), folder(spark, "postings")
    index.write(index.postings(docs, "doc_id", "text"), f"{at}/terms")
    index.write_lengths(docs, "doc_id", "text", f"{at}/lengths")
    hits = index.bm25(index.of_terms(spark, f"{at}/terms", TERMS), spark.read.parquet(f"{at}/lengths"), "doc_id", TERMS)
    return retrieval.top(hits.withColumn("score", F.round("score", 6)), "score", ["doc_id"], 50)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents) SELECT doc_id, line_no, line FROM l WHERE contains(line, 'License')")
def grep_narrowed(spark, sf_dir):
    """Lines by a literal, whose documents come from intersected trigram postings."""
    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), folder(spark, "trigrams")
    index.write(index.grams(docs, "doc_id", "text"), at)
    return index.grep(docs, at, "doc_id", "text", "License")


@query(
    """WITH t AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(text || ' fresh'), '[\\p{L}\\p{N}]+')) FROM benchmark WHERE item_id % 3 = 0)
SELECT doc_id, term, count(*)::INTEGER AS tf FROM t GROUP BY 1, 2"""
)
def postings_upsert(spark, sf_dir):
    """Postings in which a third of the documents are replaced."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    new = b.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" fresh")))
    return index.replace(index.postings(b, "doc_id", "text"), index.postings(new, "doc_id", "text"), new, "doc_id").select("doc_id", "term", "tf")


@query(
    """WITH m AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+\\.\\n[A-Z][a-z]+') AS all_m, text FROM documents)
SELECT doc_id, (turn - 1)::BIGINT AS turn, all_m[turn] AS match FROM (SELECT doc_id, all_m, unnest(range(1, len(all_m) + 1)) AS turn FROM m)"""
)
def grep_multiline(spark, sf_dir):
    """Matches that cross a line end."""
    return index.multiline(table(spark, sf_dir, "documents"), "doc_id", "text", r"[a-z]+\.\n[A-Z][a-z]+").select("doc_id", "turn", "match")


PATHS = """p AS (SELECT p_partkey AS node, CASE p_partkey % 7 WHEN 0 THEN 'src/App/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'tests/unit/' WHEN 3 THEN 'wwwroot/lib/' WHEN 4 THEN 'obj/' WHEN 5 THEN 'typings/' ELSE 'web/' END
 || 'File' || p_partkey || CASE p_size % 9 WHEN 0 THEN '.vb' WHEN 1 THEN '.aspx' WHEN 2 THEN '.min.js' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.designer.cs' WHEN 5 THEN '_test.py' WHEN 6 THEN '.tsx' WHEN 7 THEN '.h' ELSE '' END AS path FROM part)"""


def paths(spark, sf_dir):
    def pick(c, *values):
        out = None
        for i, v in enumerate(values[:-1]):
            out = F.when(c == i, v) if out is None else out.when(c == i, v)
        return out.otherwise(values[-1])

    head = pick(F.col("p_partkey") % 7, "src/App/", "node_modules/x/", "tests/unit/", "wwwroot/lib/", "obj/", "typings/", "web/")
    tail = pick(F.col("p_size") % 9, ".vb", ".aspx", ".min.js", ".d.ts", ".designer.cs", "_test.py", ".tsx", ".h", "")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat(head, F.lit("File"), s(F.col("p_partkey")), tail).alias("path"))


@query(
    f"""WITH {PATHS} SELECT node, CASE WHEN path LIKE '%.vb' THEN 'vbnet' WHEN path LIKE '%.aspx' THEN 'aspx' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.cs' THEN 'csharp' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.h' THEN 'cpp' ELSE 'text' END AS language,
 path LIKE 'node_modules/%' OR path LIKE 'wwwroot/lib/%' OR path LIKE '%.min.js' AS vendor, path LIKE 'tests/%' OR path LIKE '%_test.py' AS test, path LIKE 'obj/%' OR path LIKE '%.designer.cs' AS generated, path LIKE 'typings/%' OR path LIKE '%.d.ts' AS declaration FROM p"""
)
def path_facts(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select("node", px.language_of(p).alias("language"), px.is_vendor(p).alias("vendor"), px.is_test(p).alias("test"), px.is_generated(p).alias("generated"), px.is_declaration(p).alias("declaration"))


@query(f"WITH {PATHS} SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM p GROUP BY 1")
def extension_counts(spark, sf_dir):
    return paths(spark, sf_dir).groupBy(px.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"))


@query(f"WITH {PATHS} SELECT node, path FROM p WHERE starts_with(path, 'src/') OR regexp_matches(path, '^(?:.*/)?File[^/]*[.]tsx$')")
def scoped_paths(spark, sf_dir):
    """A prefix, or a glob that crosses folders."""
    p = F.col("path")
    return paths(spark, sf_dir).filter(F.startswith(p, F.lit("src/")) | p.rlike(px.glob_to_regex("**/File*.tsx")))


@query("SELECT p_brand AS grp, left(min(p_name), CASE WHEN min(p_name) = max(p_name) THEN length(min(p_name)) ELSE (SELECT count(*) FROM range(1, 200) t(i) WHERE left(min(p_name), i::INT) = left(max(p_name), i::INT) AND i <= length(min(p_name))) END::INT) AS prefix, count(*) AS n FROM part GROUP BY 1")
def common_prefixes(spark, sf_dir):
    return resolve.common_prefix(table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), "p_name"), "grp", "p_name")


@query("SELECT l_suppkey % 100 AS a, 100 + l_partkey % 50 AS b, max(l_linenumber) AS weight FROM lineitem GROUP BY 1, 2")
def undirected_max(spark, sf_dir):
    a, b = F.col("l_suppkey") % 100, 100 + F.col("l_partkey") % 50
    flip = F.col("l_orderkey") % 2 == 0
    rows = table(spark, sf_dir, "lineitem").select(F.when(flip, a).otherwise(b).alias("src"), F.when(flip, b).otherwise(a).alias("dst"), F.col("l_linenumber").alias("weight"))
    return graph.pair_max(rows)


@query(
    """WITH e AS (SELECT event_id AS id, user_id AS k, 'p' || (event_id % 400) AS path, (event_id % 97) / 97.0 AS score FROM events), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS t FROM e) WHERE t = 1)
SELECT id, k, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS u FROM a) WHERE u = 1"""
)
def best_evidence(spark, sf_dir):
    """The best of each key, then one per path."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i.alias("id"), F.col("user_id").alias("k"), F.concat(F.lit("p"), s(i % 400)).alias("path"), ((i % 97) / 97.0).alias("score"))
    return planning.dedup_evidence(e, "k").select("id", "k", "path")


@query(
    """WITH i AS (SELECT DISTINCT 'C' || s_suppkey AS klass, 'I' || s_nationkey AS interface FROM supplier), m AS (SELECT DISTINCT 'C' || l_suppkey AS owner, 'm' || l_partkey % 30 AS member, l_linenumber % 3 AS arity FROM lineitem UNION SELECT DISTINCT 'I' || x, 'm' || y, y % 3 FROM range(25) t(x), range(30) u(y))
SELECT interface, klass, a.member, a.arity FROM i JOIN m a ON a.owner = interface JOIN m b ON b.owner = klass AND b.member = a.member AND b.arity = a.arity"""
)
def interface_dispatch(spark, sf_dir):
    c = lambda x, col: F.concat(F.lit(x), s(F.col(col)))
    i = table(spark, sf_dir, "supplier").select(c("C", "s_suppkey").alias("klass"), c("I", "s_nationkey").alias("interface")).distinct()
    own = table(spark, sf_dir, "lineitem").select(c("C", "l_suppkey").alias("owner"), F.concat(F.lit("m"), s(F.col("l_partkey") % 30)).alias("member"), (F.col("l_linenumber") % 3).cast("long").alias("arity"))
    of = spark.range(25 * 30).select(F.concat(F.lit("I"), s(F.floor(F.col("id") / 30))).alias("owner"), F.concat(F.lit("m"), s(F.col("id") % 30)).alias("member"), (F.col("id") % 30 % 3).alias("arity"))
    return resolve.interface_dispatch(i, own.unionByName(of).distinct())


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey AS site, 'dbo.[T' || l_partkey % 40 || ']' AS tab FROM lineitem), t AS (SELECT x AS node, CASE WHEN x < 30 THEN 't' || x ELSE 'T' || (x - 5) END AS name FROM range(38) t(x)),
 k AS (SELECT lower(name) AS key, count(*) AS n, min(node) AS node FROM t GROUP BY 1)
SELECT site, tab AS "table", CASE WHEN n = 1 THEN node END AS node, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS status FROM u LEFT JOIN k ON k.key = lower(regexp_extract(tab, 'T[0-9]+'))"""
)
def schema_links(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.concat(F.lit("dbo.[T"), s(F.col("l_partkey") % 40), F.lit("]")).alias("table")).distinct()
    x = F.col("id")
    tables = spark.range(38).select(x.alias("node"), F.when(x < 30, F.concat(F.lit("t"), s(x))).otherwise(F.concat(F.lit("T"), s(x - 5))).alias("name"))
    return resolve.link_schema(uses, tables)


@query(
    """WITH RECURSIVE e AS (SELECT 'm' || x AS module, 'n' || y AS name, CASE WHEN x % 4 = 3 THEN x * 100 + y END AS node, CASE WHEN x % 4 <> 3 THEN 'm' || (x + 1) END AS from_module FROM range(40) t(x), range(5) u(y)),
 i AS (SELECT DISTINCT c_custkey AS file, 'm' || c_custkey % 40 AS module, 'n' || c_nationkey % 6 AS name FROM customer),
 r(file, module, name, cur, node) AS (SELECT file, i.module, i.name, e.from_module, e.node FROM i JOIN e ON e.module = i.module AND e.name = i.name UNION ALL SELECT file, r.module, r.name, e.from_module, e.node FROM r JOIN e ON e.module = r.cur AND e.name = r.name WHERE r.node IS NULL)
SELECT DISTINCT file, module, name, node FROM r WHERE node IS NOT NULL"""
)
def import_resolution(spark, sf_dir):
    """Names imported through chains of re-exports."""
    x, y = F.floor(F.col("id") / 5), F.col("id") % 5
    e = spark.range(200).select(F.concat(F.lit("m"), s(x)).alias("module"), F.concat(F.lit("n"), s(y)).alias("name"), F.when(x % 4 == 3, x * 100 + y).alias("node"), F.when(x % 4 != 3, F.concat(F.lit("m"), s(x + 1))).alias("from_module"))
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.concat(F.lit("m"), s(F.col("c_custkey") % 40)).alias("module"), F.concat(F.lit("n"), s(F.col("c_nationkey") % 6)).alias("name")).distinct()
    return resolve.resolve_imports(i, e)


@query(
    """SELECT o_orderkey AS call, 'p' || (o_orderkey % 3) AS parameter, 'a' || o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 'p1', o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1"""
)
def argument_binding(spark, sf_dir):
    """Each call names one parameter and gives the second by place."""
    o = table(spark, sf_dir, "orders")
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    named = pair(F.concat(F.lit("p"), s(F.col("o_orderkey") % 3)), F.concat(F.lit("a"), s(F.col("o_custkey"))))
    none = pair(F.lit(None).cast("string"), F.col("o_orderstatus"))
    args = F.when(F.col("o_orderkey") % 3 == 1, F.array(named)).otherwise(F.array(named, none))
    calls = o.select(F.col("o_orderkey").alias("call"), F.lit("f").alias("callee"), args.alias("arguments"))
    return resolve.bind_arguments(calls, spark.createDataFrame([("f", i, f"p{i}") for i in range(3)], "callee string, position int, parameter string"))


@query("SELECT DISTINCT 'r' || a.l_linenumber AS from_language, 't' || a.l_suppkey % 30 AS term, 'r' || b.l_linenumber AS to_language, 't' || b.l_suppkey % 30 AS translation FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber")
def lexicon_translation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource"), F.concat(F.lit("r"), s(F.col("l_linenumber"))).alias("language"), F.concat(F.lit("T"), s(F.col("l_suppkey") % 30)).alias("value"))
    return planning.lexicon(rows)


@query(
    """WITH RECURSIVE a AS (SELECT DISTINCT l_partkey % 300 AS src, l_suppkey % 300 AS dst, CASE WHEN l_linenumber = 1 THEN 'call' ELSE 'assign' END AS via FROM lineitem),
 r(root, node, steps) AS (SELECT x, x, 0 FROM (SELECT unnest([7, 11]::BIGINT[]) AS x) UNION SELECT r.root, a.dst, r.steps + 1 FROM r JOIN a ON a.src = r.node WHERE r.steps < 3)
SELECT root, node, min(steps) AS steps FROM r GROUP BY 1, 2"""
)
def value_flow(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 300).alias("src"), (F.col("l_suppkey") % 300).alias("dst"), F.when(F.col("l_linenumber") == 1, "call").otherwise("assign").alias("via"))
    return flows.value_flow(links, spark.createDataFrame([(7,), (11,)], "node long"), 3).select("root", "node", "steps")


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS method, 's' || l_suppkey % 25 AS state FROM lineitem) SELECT x.state AS state_a, y.state AS state_b, count(*) AS methods FROM a x JOIN a y ON x.method = y.method AND x.state < y.state GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def state_affinity(spark, sf_dir):
    return flows.state_affinity(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("method"), F.concat(F.lit("s"), s(F.col("l_suppkey") % 25)).alias("state")))


@query(
    """WITH m AS (SELECT term AS name, row_number() OVER (ORDER BY term) AS method FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\w+')) AS term FROM benchmark)), t AS (SELECT DISTINCT doc_id AS file, unnest(regexp_extract_all(text, '\\w+')) AS name FROM documents WHERE lang = 'en')
SELECT m.name, count(*) AS files FROM m JOIN t ON t.name = m.name GROUP BY 1"""
)
def tests_for_method(spark, sf_dir):
    """Methods named in benchmark texts, and how many test files mention each."""
    m = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z_]+"), F.lit(0))).alias("name")).distinct()
    tests = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("file"), "text")
    return flows.tests_for(m.withColumn("method", F.col("name")), tests).groupBy(F.col("method").alias("name")).agg(F.count("*").alias("files"))


@query(
    """WITH r AS (SELECT event_id AS event, user_id % 20 AS file, 'f' || event_id % 50 AS fn, event_id % 400 AS line FROM events WHERE event_type = 'error'), f AS (SELECT p_partkey AS node, p_partkey % 20 AS file, 'f' || p_partkey % 70 AS name, p_partkey * 3 % 400 AS a, p_partkey * 3 % 400 + p_size AS b FROM part),
 n AS (SELECT event, min(node) AS named FROM r JOIN f ON f.file = r.file AND f.name = r.fn GROUP BY 1 HAVING count(*) = 1), i AS (SELECT event, node AS inner_node FROM (SELECT event, node, row_number() OVER (PARTITION BY event ORDER BY b - a, node) AS t FROM r JOIN f ON f.file = r.file AND line BETWEEN a AND b) WHERE t = 1)
SELECT r.event, coalesce(named, inner_node) AS node, CASE WHEN named IS NOT NULL THEN 'name' WHEN inner_node IS NOT NULL THEN 'line' ELSE 'none' END AS how FROM r LEFT JOIN n ON n.event = r.event LEFT JOIN i ON i.event = r.event"""
)
def runtime_to_node(spark, sf_dir):
    i, p = F.col("event_id"), F.col("p_partkey")
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select(i.alias("event"), (F.col("user_id") % 20).alias("file"), F.concat(F.lit("f"), s(i % 50)).alias("function"), (i % 400).alias("line"))
    f = table(spark, sf_dir, "part").select(p.alias("node"), (p % 20).alias("file"), F.concat(F.lit("f"), s(p % 70)).alias("name"), (p * 3 % 400).alias("first_line"), (p * 3 % 400 + F.col("p_size")).alias("last_line"))
    return flows.runtime_nodes(rows, f)


@query(
    """WITH b AS (SELECT c_custkey AS control, 'col' || c_custkey % 15 AS field, CASE WHEN c_custkey % 2 = 0 THEN 'tab' || c_nationkey % 4 END AS source FROM customer), k AS (SELECT 'tab' || x AS tab, 'col' || y AS col FROM range(4) t(x), range(12) u(y) WHERE (x + y) % 3 <> 0)
SELECT control, field, CASE WHEN count(tab) = 1 THEN min(tab) END AS "table", CASE WHEN count(tab) = 0 THEN 'unknown' WHEN count(tab) = 1 THEN 'bound' ELSE 'ambiguous' END AS status FROM b LEFT JOIN k ON k.col = b.field AND (b.source IS NULL OR b.source = k.tab) GROUP BY control, field"""
)
def field_binding(spark, sf_dir):
    c = F.col("c_custkey")
    b = table(spark, sf_dir, "customer").select(c.alias("control"), F.concat(F.lit("Col"), s(c % 15)).alias("field"), F.when(c % 2 == 0, F.concat(F.lit("tab"), s(F.col("c_nationkey") % 4))).alias("source"))
    x, y = F.floor(F.col("id") / 12), F.col("id") % 12
    k = spark.range(48).filter((x + y) % 3 != 0).select(F.concat(F.lit("tab"), s(x)).alias("table"), F.concat(F.lit("col"), s(y)).alias("column"))
    return flows.bind_fields(b, k)


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS method, l_suppkey % 10 AS file, 't' || l_partkey % 60 AS type FROM lineitem), t AS (SELECT p_partkey AS node, 't' || p_partkey % 97 AS name, p_partkey % 10 AS file FROM part WHERE p_partkey % 3 = 0),
 j AS (SELECT method, p.file, p.type, min(node) FILTER (t.file = p.file) AS near, count(node) AS n, min(node) AS any_node FROM p LEFT JOIN t ON t.name = p.type GROUP BY 1, 2, 3) SELECT method, type, coalesce(near, CASE WHEN n = 1 THEN any_node END) AS node FROM j"""
)
def signature_types(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("method"), (F.col("l_suppkey") % 10).alias("file"), F.concat(F.lit("My.T"), s(F.col("l_partkey") % 60), F.lit("(Of String)")).alias("type"))
    t = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("T"), s(F.col("p_partkey") % 97)).alias("name"), (F.col("p_partkey") % 10).alias("file"))
    return flows.signature_types(p, t)


@query(
    """WITH c AS (SELECT o_orderkey AS call, 'g' || o_custkey % 80 AS name, o_orderkey % 4 AS arguments FROM orders), f AS (SELECT s_suppkey AS node, 'g' || s_suppkey % 60 AS name, s_suppkey % 3 AS least, s_suppkey % 3 + 1 AS most FROM supplier)
SELECT call, min(node) AS node FROM c JOIN f ON f.name = c.name AND arguments BETWEEN least AND most GROUP BY 1 HAVING count(*) = 1"""
)
def global_functions(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.concat(F.lit("G"), s(F.col("o_custkey") % 80)).alias("name"), (F.col("o_orderkey") % 4).alias("arguments"))
    k = F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(k.alias("node"), F.concat(F.lit("App.g"), s(k % 60)).alias("name"), (k % 3).alias("least"), (k % 3 + 1).alias("most"))
    return flows.global_calls(c, f)


@query(
    """WITH k AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), f AS (SELECT 'r' || r_regionkey AS file FROM region)
SELECT file, member, min(level) AS level FROM (SELECT file, b AS member, 1 AS level FROM f JOIN k ON a = file UNION ALL SELECT file, y.b, 2 FROM f JOIN k x ON x.a = file JOIN k y ON y.a = x.b) GROUP BY 1, 2"""
)
def component_members(spark, sf_dir):
    c = lambda x, col: F.concat(F.lit(x), s(F.col(col)))
    k = table(spark, sf_dir, "nation").select(c("r", "n_regionkey"), c("n", "n_nationkey")).union(table(spark, sf_dir, "supplier").select(c("n", "s_nationkey"), c("s", "s_suppkey")))
    return flows.component_members(k.toDF("a", "b"), table(spark, sf_dir, "region").select(c("r", "r_regionkey").alias("node")))


@query("SELECT DISTINCT p_type || '.' || x AS name, x IN ('IsNothing', 'CStr(a.b)') AS builtin FROM (SELECT p_type, unnest(['IsNothing', 'x', 'CStr(a.b)', p_brand]) AS x FROM part)")
def builtin_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", F.explode(F.array(F.lit("IsNothing"), F.lit("x"), F.lit("CStr(a.b)"), F.col("p_brand"))).alias("x"))
    return p.select(F.concat("p_type", F.lit("."), "x").alias("name")).distinct().select("name", flows.is_builtin(F.col("name")).alias("builtin"))


@query(
    """WITH l AS (SELECT doc_id AS file, CASE doc_id % 5 WHEN 0 THEN 'q = "SELECT * FROM t WHERE id = " & id' WHEN 1 THEN 'cmd.Parameters.AddWithValue("@id", id)' WHEN 2 THEN 'x = 1' ELSE 'q = "select a from b" + c' END AS line FROM documents UNION ALL SELECT doc_id, 'WHERE id = @id' FROM documents WHERE doc_id % 5 = 3),
 m AS (SELECT file, regexp_matches(line, '(?i)(?:select|insert|update|delete)\\b[^"'']*["'']\\s*(?:&|\\+)') AS joined, regexp_matches(line, '(?i)(?:addwithvalue|parameters\\.add|@\\w+)') AS bound FROM l)
SELECT file, sum(joined::INT)::BIGINT AS joined, sum(bound::INT)::BIGINT AS bound, CASE WHEN sum(joined::INT) = 0 THEN 'parameterised' WHEN sum(bound::INT) = 0 THEN 'injectable' ELSE 'mixed' END AS strategy FROM m GROUP BY 1 HAVING sum(joined::INT) > 0 OR sum(bound::INT) > 0"""
)
def sql_strategy(spark, sf_dir):
    d = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents")
    line = F.when(d == 0, 'q = "SELECT * FROM t WHERE id = " & id').when(d == 1, 'cmd.Parameters.AddWithValue("@id", id)').when(d == 2, "x = 1").otherwise('q = "select a from b" + c')
    rows = docs.select(F.col("doc_id").alias("file"), line.alias("line")).unionByName(docs.filter(d == 3).select(F.col("doc_id").alias("file"), F.lit("WHERE id = @id").alias("line")))
    return flows.sql_risk(rows)


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND (event_id % 10 = 1 OR event_type = 'error')")
def retained_evidence(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(i.alias("id"), F.concat(F.lit("App\\m"), s(i % 10), F.lit("\\x.vb")).alias("path"), F.concat(F.lit("an "), "event_type", F.lit(" was seen")).alias("text"))
    return flows.retained_evidence(e, ["app/m1/"], ["Error"]).select("id")


@query(
    """WITH h AS (SELECT vec_id, vec_id % 89 / 89.0 AS score FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS turn FROM h)
SELECT vec_id, round(CASE WHEN turn <= 100 AND vec_id % 4 <> 0 THEN 0.5 * score + 0.5 * (vec_id % 7) / 7.0 ELSE 0.5 * score END, 6) AS score, CASE WHEN turn > 100 THEN 'over_budget' WHEN vec_id % 4 = 0 THEN 'missing' ELSE 'applied' END AS semantic_status FROM r"""
)
def semantic_rerank(spark, sf_dir):
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    out = flows.rerank(e.select("vec_id", (v % 89 / 89.0).alias("score")), e.filter(v % 4 != 0).select("vec_id", ((v % 7) / 7.0).alias("semantic")), "vec_id", 100)
    return out.withColumn("score", F.round("score", 6))


@query(
    """WITH n AS (SELECT o_custkey AS change, count(*) AS reverts FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 2)
SELECT n.change, reverts, len(list_distinct(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[\\p{L}\\p{N}]+')))::INTEGER AS terms FROM n JOIN customer ON c_custkey = change"""
)
def harvested_patterns(spark, sf_dir):
    reverts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("change"))
    hunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("change"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("text"))
    return flows.harvest(reverts, hunks, 2).select("change", "reverts", F.size("terms").alias("terms"))


@query("SELECT p_type AS api, count(*) AS sites, count(DISTINCT l_orderkey) AS files, CASE WHEN p_type = 'ECONOMY' THEN 'tiles' ELSE 'none known' END AS replacement FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def api_inventory(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("api"), F.col("l_orderkey").alias("file"))
    return flows.api_inventory(calls, spark.createDataFrame([("ECONOMY", "tiles")], "api string, replacement string"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (3, 50, 77, 1000000)")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(3, 50, 77, 1_000_000)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(doc_id) AS latest FROM documents GROUP BY 1, 2")
def catalog_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("latest"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'license|thing'))::BIGINT AS n FROM documents")
def needle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.occurrences(F.lower("text"), "license|thing").alias("n"))


@query(
    """SELECT doc_id AS file, 'windows_service' AS pattern FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'timer_service' FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT doc_id, 'hangfire_job' FROM documents WHERE doc_id % 4 = 1"""
)
def background_services(spark, sf_dir):
    d = F.col("doc_id")
    more = F.when(d % 8 == 0, " Inherits ServiceBase: New System.Timers.Timer()").when(d % 4 == 0, " Inherits ServiceBase").when(d % 4 == 1, " RecurringJob.AddOrUpdate(x)").otherwise(" Quartz IJob")
    return flows.background_services(table(spark, sf_dir, "documents").select(d.alias("file"), F.concat("text", more).alias("text"))).select("file", "pattern")

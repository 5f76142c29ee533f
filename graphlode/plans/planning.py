"""Planning, migration and database queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import embed, graph, migration, planning, temporal
from graphlode.plans import query
from graphlode.plans.history import EDITED, LIST, PAIRS, files


@query(
    """WITH r AS (SELECT p_partkey AS item, p_brand AS grp, CASE WHEN lower(p_name) = 'rings' THEN 3 WHEN regexp_matches(lower(p_name), '(^|[^a-z])ring') THEN 2 WHEN contains(lower(p_name), 'ring') THEN 1 ELSE 0 END AS fit FROM part),
 k AS (SELECT grp, item, fit, row_number() OVER (PARTITION BY grp ORDER BY fit DESC, item) AS turn, count(*) OVER (PARTITION BY grp) AS total FROM r WHERE fit > 0) SELECT grp, item, fit, turn, total FROM k WHERE turn <= 5"""
)
def concept_footprint(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("grp"), "p_name")
    return planning.footprint(p, "rings", "item", "grp", "p_name", 5).withColumn("turn", F.col("turn").cast("long"))


@query(
    f"""WITH {PAIRS}, c AS (SELECT CASE WHEN file_a IN ({LIST}) THEN file_b ELSE file_a END AS file, sum(weight)::DOUBLE AS score FROM pairs WHERE (file_a IN ({LIST})) <> (file_b IN ({LIST})) GROUP BY 1),
 n AS (SELECT p_partkey AS file, 1.0 AS score FROM part WHERE contains(p_name, 'ring')), f AS (SELECT p_partkey AS file, p_size / 50.0 AS score FROM part WHERE p_size > 45),
 u AS (SELECT file, score * 1.0 AS part, 'cochange' AS arm, true AS strong FROM c UNION ALL SELECT file, score * 0.8, 'concept', true FROM n UNION ALL SELECT file, score * 0.3, 'family', false FROM f),
 g AS (SELECT file, sum(part) AS score, string_agg(arm, ',' ORDER BY arm) AS arms, bool_or(strong) AS strong FROM u GROUP BY 1)
SELECT file, round(score, 6) AS score, arms, strong AND row_number() OVER (PARTITION BY strong ORDER BY score DESC, file) <= 40 AS is_primary FROM g"""
)
def change_set(spark, sf_dir):
    pairs = temporal.cochanges(files(spark, sf_dir))
    a, b = F.col("file_a").isin(EDITED), F.col("file_b").isin(EDITED)
    coupled = pairs.filter(a != b).select(F.when(a, F.col("file_b")).otherwise(F.col("file_a")).alias("file"), "weight").groupBy("file").agg(F.sum("weight").cast("double").alias("score"))
    p = table(spark, sf_dir, "part")
    concept = p.filter(F.contains("p_name", F.lit("ring"))).select(F.col("p_partkey").alias("file"), F.lit(1.0).alias("score"))
    family = p.filter("p_size > 45").select(F.col("p_partkey").alias("file"), (F.col("p_size") / 50.0).alias("score"))
    return planning.change_set({"cochange": (coupled, 1.0), "concept": (concept, 0.8), "family": (family, 0.3)}, 40).withColumn("score", F.round("score", 6))


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS session, o_orderkey % 11 AS file FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT DISTINCT o_custkey AS session, o_orderkey % 11 AS file FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(p.session, e.session) AS session, coalesce(p.file, e.file) AS file, CASE WHEN p.file IS NOT NULL AND e.file IS NOT NULL THEN 'done' WHEN p.file IS NOT NULL THEN 'skipped' ELSE 'unplanned' END AS status
FROM p FULL JOIN e ON p.session = e.session AND p.file = e.file"""
)
def edit_session_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_orderkey") % 11).alias("file"), "o_orderkey")
    return planning.session_drift(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"))


@query(
    """WITH a AS (SELECT c_custkey AS row_no, sha256(c_name) AS want FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_custkey AS row_no, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE sha256(c_name) END AS got FROM customer WHERE c_custkey % 10 <> 4)
SELECT coalesce(a.row_no, b.row_no) AS row_no, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' WHEN want = got THEN 'ok' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.row_no = b.row_no"""
)
def feature_contract(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 10 != 3").select("c_custkey", F.sha2("c_name", 256))
    b = c.filter("c_custkey % 10 != 4").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.sha2("c_name", 256)))
    return planning.check_contract(a, b)


@query("SELECT l_returnflag AS kind, l_suppkey AS item, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 3")
def implementation_pattern(spark, sf_dir):
    """Ingredients that several exemplars share."""
    li = table(spark, sf_dir, "lineitem")
    return planning.common_ingredients(li.select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("item")), 3)


CALLS = "c AS (SELECT DISTINCT l_orderkey % 500 AS caller, l_partkey % 700 AS callee FROM lineitem)"


@query(
    f"""WITH {CALLS}, d AS (SELECT DISTINCT caller FROM c WHERE callee % 50 = 0), h AS (SELECT DISTINCT caller FROM c WHERE callee IN (SELECT caller FROM d)), f AS (SELECT x AS function FROM range(700) t(x))
SELECT function, CASE WHEN function IN (SELECT caller FROM d) OR function IN (SELECT caller FROM h) THEN 'guarded' WHEN function IN (SELECT caller FROM c) THEN 'unguarded' ELSE 'unknown' END AS status FROM f"""
)
def guards_map(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("caller"), (F.col("l_partkey") % 700).alias("callee")).distinct()
    guards = spark.range(0, 700, 50).select(F.col("id").alias("guard"))
    return planning.guard_status(spark.range(700).select(F.col("id").alias("function")), calls, guards)


@query(
    """WITH e AS (SELECT user_id AS q, event_id, (event_id % 100) / 100.0 AS score, event_id % 9 = 0 AS stale, event_type AS subject FROM events WHERE event_id % 3 = 0),
 a AS (SELECT user_id AS q FROM events GROUP BY 1), g AS (SELECT a.q, count(e.score) AS n, max(score) AS best, bool_and(coalesce(stale, false)) AS all_stale, count(DISTINCT CASE WHEN score >= 0.6 THEN subject END) AS subjects FROM a LEFT JOIN e ON a.q = e.q GROUP BY 1)
SELECT q, CASE WHEN n = 0 THEN 'unsupported' WHEN all_stale THEN 'stale' WHEN subjects > 1 THEN 'ambiguous' WHEN best >= 0.6 THEN 'answered' ELSE 'partial' END AS status, n FROM g"""
)
def answer_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    found = e.filter("event_id % 3 = 0").select(F.col("user_id").alias("q"), ((i % 100) / 100.0).alias("score"), (i % 9 == 0).alias("stale"), F.col("event_type").alias("subject"))
    return planning.answer_status(e.select(F.col("user_id").alias("q")).distinct().join(found, "q", "left"), "q")


@query("SELECT user_id AS subject, sum((event_type = 'purchase')::INT)::BIGINT AS yes, sum((event_type <> 'purchase')::INT)::BIGINT AS no FROM events WHERE event_type IN ('purchase', 'error') AND value > 80 GROUP BY 1 HAVING yes > 0 AND no > 0")
def evidence_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error') AND value > 80")
    return planning.conflicts(e.select(F.col("user_id").alias("subject"), (F.col("event_type") == "purchase").alias("positive")))


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey * 3 FROM part WHERE p_partkey % 4 = 1),
 r(root, node, depth) AS (SELECT x, x, 0 FROM (SELECT unnest([1, 5, 9]::BIGINT[]) AS x) UNION SELECT r.root, a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.node WHERE r.depth < 4) SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2"""
)
def procedure_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    calls = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2).alias("dst")).unionByName(p.filter("p_partkey % 4 = 1").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 3).alias("dst")))
    return migration.chain(calls, spark.createDataFrame([(1,), (5,), (9,)], "node long"), 4)


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part WHERE p_partkey > 0), l AS (SELECT p_partkey % 50 AS loop, p_partkey AS node FROM part WHERE p_partkey > 0), d AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 10 = 0),
 r(root, node, depth) AS (SELECT node, node, 0 FROM l UNION SELECT r.root, a.dst, r.depth + 1 FROM r JOIN a ON a.src = r.node WHERE r.depth < 4), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2),
 h AS (SELECT root, min(depth) AS depth, count(*) AS targets FROM m WHERE node IN (SELECT node FROM d) GROUP BY 1) SELECT loop, min(depth) AS depth, sum(targets)::BIGINT AS targets FROM l JOIN h ON h.root = l.node GROUP BY 1"""
)
def n_plus_one(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    calls = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2).alias("dst"))
    loops = p.filter("p_partkey > 0").select((F.col("p_partkey") % 50).alias("loop"), F.col("p_partkey").alias("node"))
    return migration.n_plus_one(loops, calls, p.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node")))


@query(
    """WITH p AS (SELECT 't' || (l_suppkey % 9) AS table_name, 'c' || (l_partkey % 13) AS column_name, l_orderkey AS site FROM lineitem), i AS (SELECT 't' || (x % 9) AS table_name, 'c' || (x % 13) AS column_name FROM range(40) t(x))
SELECT table_name, column_name, count(DISTINCT site) AS sites FROM p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.table_name = p.table_name AND i.column_name = p.column_name) GROUP BY 1, 2"""
)
def missing_indexes(spark, sf_dir):
    s = lambda c: c.cast("string")
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), s(F.col("l_suppkey") % 9)).alias("table_name"), F.concat(F.lit("c"), s(F.col("l_partkey") % 13)).alias("column_name"), F.col("l_orderkey").alias("site"))
    i = spark.range(40).select(F.concat(F.lit("t"), s(F.col("id") % 9)).alias("table_name"), F.array(F.concat(F.lit("c"), s(F.col("id") % 13))).alias("columns"))
    return migration.missing_indexes(p, i)


USES = "u AS (SELECT DISTINCT l_partkey % 60 AS state, l_suppkey AS file, CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'write' ELSE 'read' END AS access FROM lineitem)"


def uses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_partkey") % 60).alias("state"), F.col("l_suppkey").alias("file"), F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "write").otherwise("read").alias("access")).distinct()


@query(
    f"""WITH {USES}, a AS (SELECT state, count(DISTINCT file) FILTER (access = 'write') AS writers, count(DISTINCT file) FILTER (access = 'read') AS readers, count(DISTINCT file) AS files FROM u GROUP BY 1)
SELECT *, CASE WHEN readers = 0 THEN 'remove' WHEN writers = 0 THEN 'configuration' WHEN files = 1 THEN 'local' WHEN writers = 1 AND readers <= 5 THEN 'service' ELSE 'distributed_cache' END AS strategy FROM a"""
)
def state_migration(spark, sf_dir):
    return migration.state_strategy(uses(spark, sf_dir))


@query(f"WITH {USES} SELECT w.state, count(*) AS flows, count(DISTINCT w.file) AS writers, count(DISTINCT r.file) AS readers FROM u w JOIN u r ON w.state = r.state AND w.file <> r.file WHERE w.access = 'write' AND r.access = 'read' GROUP BY 1")
def session_workflows(spark, sf_dir):
    return migration.workflows(uses(spark, sf_dir))


@query(
    """WITH f AS (SELECT o_custkey AS page, o_orderstatus AS d FROM orders), a AS (SELECT page, bool_or(d = 'F') AS "F", bool_or(d = 'O') AS "O", bool_or(d = 'P') AS "P" FROM f GROUP BY 1)
SELECT c_custkey AS page, coalesce("F", false) AS "F", coalesce("O", false) AS "O", coalesce("P", false) AS "P", round((coalesce("F", false)::INT + coalesce("O", false)::INT + coalesce("P", false)::INT) / 3.0, 6) AS share FROM customer LEFT JOIN a ON a.page = c_custkey"""
)
def migration_coverage(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("dimension"))
    return migration.coverage(pages, facts, ["F", "O", "P"]).withColumn("share", F.round("share", 6))


@query("SELECT o_custkey AS item, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS t FROM orders) WHERE t = 1")
def migration_status_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return migration.latest_status(o).select("item", "status")


@query(
    """WITH m AS (SELECT c_custkey AS method, count(o_orderkey) AS writes, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT method, axis FROM (SELECT method, CASE WHEN writes = 0 THEN 'empty_input' END AS axis FROM m UNION ALL SELECT method, CASE WHEN writes > 10 THEN 'concurrency' END FROM m UNION ALL SELECT method, CASE WHEN top > 400000 THEN 'boundary' END FROM m) WHERE axis IS NOT NULL"""
)
def test_matrix(spark, sf_dir):
    m = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("method")).agg(F.count("o_orderkey").alias("writes"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("top"))
    return migration.test_axes(m, [("empty_input", "writes = 0"), ("concurrency", "writes > 10"), ("boundary", "top > 400000")])


@query(
    """WITH m AS (SELECT p_partkey AS method, count(l_orderkey) AS callers, any_value(p_size) AS complexity, p_partkey % 3 <> 0 AS tested FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT method, CASE WHEN callers > 20 OR complexity > 25 OR (callers > 5 AND NOT tested) THEN 'red' WHEN callers > 5 OR complexity > 10 OR NOT tested THEN 'yellow' ELSE 'green' END AS verdict FROM m"""
)
def edit_safety(spark, sf_dir):
    callers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("callers"))
    m = table(spark, sf_dir, "part").join(callers, "p_partkey", "left").select(F.col("p_partkey").alias("method"), F.coalesce("callers", F.lit(0)).alias("callers"), F.col("p_size").alias("complexity"), (F.col("p_partkey") % 3 != 0).alias("tested"))
    return migration.edit_safety(m)


@query(
    """WITH RECURSIVE c AS (SELECT 'region' || n_regionkey AS src, 'nation' || n_nationkey AS dst, n_nationkey AS position FROM nation UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey, s_suppkey FROM supplier),
 t(node, level, trail) AS (SELECT 'region' || r_regionkey, 0, 'region' || r_regionkey FROM region UNION ALL SELECT c.dst, t.level + 1, t.trail || '/' || lpad(CAST(c.position AS VARCHAR), 4, '0') || ':' || c.dst FROM t JOIN c ON c.src = t.node) SELECT node, level, trail FROM t"""
)
def ui_blueprint(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("nation"), F.col("n_nationkey")).alias("dst"), F.col("n_nationkey").cast("long").alias("position"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("supplier"), F.col("s_suppkey")).alias("dst"), F.col("s_suppkey").cast("long").alias("position"))
    return migration.blueprint(n.unionByName(s), table(spark, sf_dir, "region").select(F.concat(F.lit("region"), F.col("r_regionkey")).alias("node")))


@query("SELECT o_orderpriority AS setting, o_custkey AS site, n, turn, total FROM (SELECT o_orderpriority, o_custkey, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS turn, sum(count(*)) OVER (PARTITION BY o_orderpriority)::BIGINT AS total FROM orders GROUP BY 1, 2) WHERE turn <= 5")
def settings_top_sites(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("setting"), F.col("o_custkey").alias("site"))
    return migration.ranked_sites(o, "setting", "site", 5).withColumn("turn", F.col("turn").cast("long"))


@query(
    """SELECT r_name AS route, n_name AS handler, s_suppkey AS statement, count(DISTINCT l_partkey) AS tables FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE r_name = 'EUROPE' GROUP BY 1, 2, 3"""
)
def request_trace(spark, sf_dir):
    """Route to handler to statement to tables."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("region").filter("r_name = 'EUROPE'").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("r_name").alias("route"), F.col("n_name").alias("handler"), F.col("s_suppkey").alias("statement")).agg(F.count_distinct("l_partkey").alias("tables"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents),
 h AS (SELECT doc_id, line_no, 'licence' AS rule FROM l WHERE regexp_matches(line, '(?i)licensed') UNION ALL SELECT doc_id, line_no, 'mail' FROM l WHERE regexp_matches(line, '[A-Za-z0-9._]+@[A-Za-z0-9]+') UNION ALL SELECT doc_id, line_no, 'markup' FROM l WHERE regexp_matches(line, '[#*$%&]{3}'))
SELECT doc_id, rule, count(*) AS n FROM h GROUP BY 1, 2"""
)
def rule_pack(spark, sf_dir):
    """Rules on lines: each line is tested once against all of them."""
    from graphlode.operators import retrieval

    rows = retrieval.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    rules = [("licence", "(?i)licensed", ""), ("mail", "[A-Za-z0-9._]+@[A-Za-z0-9]+", ""), ("markup", "[#*$%&]{3}", "")]
    return migration.rule_hits(rows, rules).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS dst, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 8")
def shared_targets(spark, sf_dir):
    return migration.repeated_targets(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), 8)


@query()
def projection_embeddings(spark, sf_dir):
    out = embed.embed(table(spark, sf_dir, "documents"), "doc_id", "text", 64)
    return out.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query(
    """WITH q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) AS qe FROM embeddings WHERE vec_id % 50 = 0),
 c AS (SELECT query, vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qe), 6) AS score FROM q CROSS JOIN embeddings), r AS (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM c)
SELECT query, rank, score FROM r WHERE rank <= 10"""
)
def vector_search_batch(spark, sf_dir):
    """A stated list of queries against all vectors, in one pass."""
    e = table(spark, sf_dir, "embeddings")
    queries = embed.query_set(e.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    out = embed.nearest(e, "vec_id", "embedding", queries, 10, digits=6)
    return out.select("query", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT s_suppkey AS node, s_suppkey % 7 AS kind, count(*) OVER (PARTITION BY s_suppkey % 7) AS of_kind FROM supplier WHERE s_acctbal > 0")
def node_inventory(spark, sf_dir):
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 7).alias("kind"))
    return s.withColumn("of_kind", F.count("*").over(Window.partitionBy("kind")))


@query("SELECT p_brand AS cluster, count(*) AS size, sha256(string_agg(CAST(p_partkey AS VARCHAR), chr(0) ORDER BY CAST(p_partkey AS VARCHAR))) AS fingerprint FROM part GROUP BY 1 HAVING count(*) >= 3")
def cluster_fingerprints(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label"))
    return graph.clusters(labels, 3, 1_000_000).withColumnRenamed("label", "cluster")


@query(
    """WITH l AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS turn FROM benchmark), s AS (SELECT *, sum(strlen(text)) OVER (ORDER BY item_id) AS upto FROM l WHERE turn >= 5)
SELECT item_id, turn + 1 AS next_start FROM s WHERE upto <= 2000 OR turn = 5"""
)
def byte_budget_page(spark, sf_dir):
    """A page of a report under a budget of bytes, with where to go on."""
    from graphlode.operators import retrieval

    out = retrieval.byte_page(table(spark, sf_dir, "benchmark"), ["item_id"], "text", 2000, start=5)
    return out.select("item_id", F.col("next_start").cast("long").alias("next_start"))


@query(
    """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), g AS (SELECT unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END) AS gram FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY 1"""
)
def ngram_counts(spark, sf_dir):
    from graphlode.functions import text as tx
    from graphlode.operators import retrieval

    return table(spark, sf_dir, "benchmark").select(F.explode(retrieval.ngrams(tx.words(F.col("text")), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT page_id AS caller, regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/]*|[?#].*$', '', 'g'), '/+$', '') AS k FROM pages), d AS (SELECT caller, regexp_replace(k, '/[0-9]+$', '/{}') AS k FROM c),
 h AS (SELECT 'handler_' || x AS handler, '/' || x || '/{}' AS k FROM (SELECT unnest(['en', 'fr', 'de']) AS x)) SELECT caller, handler FROM d JOIN h ON d.k = h.k"""
)
def route_resolution(spark, sf_dir):
    from graphlode.operators import resolve

    calls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("caller"), "url")
    handlers = spark.createDataFrame([(f"handler_{x}", f"/{x}/{{id}}") for x in ("en", "fr", "de")], "handler string, route string")
    return resolve.resolve_routes(calls, handlers).select("caller", "handler")


@query(
    """WITH l AS (SELECT vec_id AS node, label FROM embeddings), t AS (SELECT DISTINCT label, doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM l JOIN documents ON doc_id = node),
 n AS (SELECT label, term, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT term, count(*) AS c FROM n GROUP BY 1), x AS (SELECT n.label, n.term, n.n, round(n.n * ln(1 + (SELECT count(DISTINCT label) FROM l)::DOUBLE / c), 6) AS score FROM n JOIN s ON s.term = n.term)
SELECT label, score, turn FROM (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS turn FROM x) WHERE turn <= 3"""
)
def cluster_summaries(spark, sf_dir):
    """The scores of the three terms that set each cluster apart."""
    from pyspark.sql.window import Window

    from graphlode.operators import extract

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), "label")
    top = extract.cluster_terms(labels, table(spark, sf_dir, "documents"), "doc_id", "text", 3).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("label").orderBy(F.desc("score"), "term")
    return top.select("label", "score", F.row_number().over(w).cast("long").alias("turn"))


@query(
    """WITH i AS (SELECT o_orderkey AS path, o_custkey AS mark FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS mark FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(f.path, i.path) AS path, coalesce(f.mark, i.mark) AS mark FROM i FULL JOIN f ON i.path = f.path"""
)
def working_overlay(spark, sf_dir):
    """Indexed rows with fresh ones in place of the stale."""
    from graphlode.operators import resolve

    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("mark"))
    new = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 10 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("mark"))
    return resolve.overlay(old, new, "path", "mark")

"""Graphs: suppliers and the parts they ship, regions that contain nations, derived wirings."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import dealt, table
from graphlode.operators import graph, temporal
from graphlode.plans import query
from graphlode.plans.history import PAIRS, files

EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
WIRING = """n AS (SELECT count(*) AS n FROM supplier),
 w AS (SELECT s_suppkey AS src, (s_suppkey * 2 + 1) % n AS dst FROM supplier, n UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 5 = 0)"""


def ships(spark, sf_dir):
    """Distinct edges from suppliers to parts."""
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def wiring(spark, sf_dir):
    """A directed graph with cycles over suppliers."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    a = s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 2 + 1) % n).alias("dst"))
    return a.unionByName(s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 3).alias("dst")))


def coupled(spark, sf_dir, least=2):
    return temporal.cochanges(files(spark, sf_dir)).filter(F.col("weight") >= least).select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"), "weight")


@query(
    """SELECT node_type, count(*) AS n FROM (SELECT 'supplier' AS node_type FROM supplier UNION ALL SELECT 'part' FROM part UNION ALL SELECT 'customer' FROM customer
UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'region' FROM region) GROUP BY 1"""
)
def node_type_counts(spark, sf_dir):
    rows = None
    for t in ("supplier", "part", "customer", "nation", "region"):
        one = table(spark, sf_dir, t).select(F.lit(t).alias("node_type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("node_type").agg(F.count("*").alias("n"))


@query(
    """SELECT edge_kind, count(*) AS n, sum(w)::BIGINT AS weight FROM (SELECT 'ships' AS edge_kind, count(*) AS w FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 'located', 1 FROM supplier UNION ALL SELECT 'located', 1 FROM customer UNION ALL SELECT 'contains', 1 FROM nation) GROUP BY 1"""
)
def edge_kind_counts(spark, sf_dir):
    one = lambda t, k: table(spark, sf_dir, t).select(F.lit(k).alias("edge_kind"), F.lit(1).cast("long").alias("w"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("w")).select(F.lit("ships").alias("edge_kind"), "w")
    rows = rows.unionByName(one("supplier", "located")).unionByName(one("customer", "located")).unionByName(one("nation", "contains"))
    return rows.groupBy("edge_kind").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


@query(
    f"""WITH {EDGES} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree
FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1"""
)
def degree_centrality(spark, sf_dir):
    return graph.degrees(ships(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH {EDGES}, nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
 deg AS (SELECT src, count(*) AS d FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, n)"""
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out += f""",
 r{i} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(f.f, 0.0) + k.k / n) AS r FROM nodes CROSS JOIN n
  CROSS JOIN (SELECT coalesce(sum(r), 0.0) AS k FROM {p} ANTI JOIN deg ON {p}.node = deg.src) k
  LEFT JOIN (SELECT e.dst, sum(r / d) AS f FROM {p} JOIN e ON e.src = {p}.node JOIN deg ON deg.src = e.src GROUP BY 1) f ON f.dst = nodes.node)"""
    return out + f" SELECT node, round(r, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql(20))
def pagerank_20(spark, sf_dir):
    return graph.pagerank(ships(spark, sf_dir)).withColumn("rank", F.round("rank", 8))


BFS = f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 b(node, distance) AS (SELECT 's1', 0 UNION SELECT u.dst, b.distance + 1 FROM b JOIN u ON u.src = b.node WHERE b.distance < 2)"""


@query(f"{BFS} SELECT node, min(distance) AS distance FROM b GROUP BY 1")
def bfs_from_supplier(spark, sf_dir):
    seeds = spark.createDataFrame([("s1",)], "node string")
    return graph.traverse(ships(spark, sf_dir), seeds, 2, "both")


@query(
    """WITH RECURSIVE a AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier UNION SELECT s_suppkey // 2, s_suppkey FROM supplier),
 b(node, distance) AS (SELECT 9::BIGINT, 0 UNION SELECT a.dst, b.distance + 1 FROM b JOIN a ON a.src = b.node WHERE b.distance < 12)
SELECT (SELECT min(distance) FROM b WHERE node = 6) AS steps"""
)
def shortest_path_length(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 2).alias("dst"))
    path = graph.shortest_path(s, 9, 6, 12, "both")
    return spark.createDataFrame([(len(path) - 1,)], "steps int")


@query(
    """WITH RECURSIVE h AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
 p(node, path) AS (SELECT 'r0', 'r0' UNION ALL SELECT h.dst, p.path || '/' || h.dst FROM p JOIN h ON h.src = p.node) SELECT path FROM p WHERE node <> 'r0'"""
)
def containment_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    return graph.simple_paths(n.unionByName(s), "r0", 2, branch=1_000_000).select(F.array_join("path", "/").alias("path"))


SCC = f"""WITH RECURSIVE {WIRING}, r(a, b) AS (SELECT src, dst FROM w UNION SELECT r.a, w.dst FROM r JOIN w ON w.src = r.b),
 m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query(f"{SCC} SELECT s_suppkey AS node, coalesce(m.component, s_suppkey) AS component FROM supplier LEFT JOIN m ON m.node = s_suppkey")
def strong_components(spark, sf_dir):
    return graph.strong_components(wiring(spark, sf_dir))


@query(f"{SCC} SELECT component, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 2")
def dependency_cycles(spark, sf_dir):
    return graph.cycles(wiring(spark, sf_dir))


def _lpa_sql(rounds: int) -> str:
    out = f"""WITH {PAIRS}, d AS (SELECT file_a AS src, file_b AS dst, weight FROM pairs WHERE weight >= 2 UNION ALL SELECT file_b, file_a, weight FROM pairs WHERE weight >= 2),
 a AS MATERIALIZED (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS t FROM d) WHERE t <= 128),
 l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS label FROM a)"""
    for i in range(1, rounds + 1):
        out += f""",
 l{i} AS MATERIALIZED (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY v DESC, label) AS t
  FROM (SELECT a.src, l.label, sum(a.weight) AS v FROM a JOIN l{i - 1} l ON l.node = a.dst GROUP BY 1, 2)) WHERE t = 1)"""
    return out + f" SELECT node, label FROM l{rounds}"


@query(_lpa_sql(5))
def lpa_clusters(spark, sf_dir):
    return graph.label_propagation(coupled(spark, sf_dir))


@query(
    _lpa_sql(5).replace(" SELECT node, label FROM l5", "")
    + """, s AS (SELECT x.label AS la, y.label AS lb, p.weight FROM pairs p JOIN l5 x ON x.node = p.file_a JOIN l5 y ON y.node = p.file_b WHERE p.weight >= 2),
 u AS (SELECT la AS label, weight, la = lb AS inside FROM s UNION ALL SELECT lb, weight, false FROM s WHERE la <> lb)
SELECT label, coalesce(sum(weight) FILTER (inside), 0)::BIGINT AS internal, coalesce(sum(weight) FILTER (NOT inside), 0)::BIGINT AS external,
 round(coalesce(sum(weight) FILTER (inside), 0)::DOUBLE / sum(weight), 6) AS cohesion FROM u GROUP BY 1"""
)
def module_cohesion(spark, sf_dir):
    edges = coupled(spark, sf_dir)
    return graph.cohesion(edges, graph.label_propagation(edges)).withColumn("cohesion", F.round("cohesion", 6))


@query()
def betweenness_pivots(spark, sf_dir):
    return graph.betweenness(wiring(spark, sf_dir), pivots=8).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {EDGES}, d AS (SELECT dst AS node, count(*)::DOUBLE AS i FROM e GROUP BY 1), q AS (SELECT 'p' || l_partkey AS node, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
 m AS (SELECT max(i) AS mi, (SELECT max(v) FROM q) AS mv FROM d)
SELECT d.node, round((0.4 * i / mi + 0.6 * v / mv) / 1.0, 6) AS blend FROM d JOIN q ON q.node = d.node CROSS JOIN m"""
)
def centrality_blend(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node")
    facts = li.groupBy(part).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity"))
    return graph.blend(facts, {"suppliers": 0.4, "quantity": 0.6}).withColumn("blend", F.round("blend", 6))


@query(
    """WITH RECURSIVE t(node, wave) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT p.p_partkey, t.wave + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.node AND p.p_partkey > 0)
SELECT node, wave FROM t"""
)
def topo_waves(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.waves(p, p.select(F.col("node").alias("src"), F.floor(F.col("node") / 2).alias("dst")))


@query()
def topo_waves_with_cycles(spark, sf_dir):
    e = wiring(spark, sf_dir)
    return graph.waves(graph.nodes_of(e), e)


IMPACT = f"""WITH RECURSIVE {WIRING}, b(node, distance) AS (SELECT 3::BIGINT, 0 UNION SELECT w.src, b.distance + 1 FROM b JOIN w ON w.dst = b.node WHERE b.distance < 4)"""


@query(f"{IMPACT} SELECT node, min(distance) AS distance FROM b GROUP BY 1")
def impact_walk(spark, sf_dir):
    e = wiring(spark, sf_dir).withColumn("kind", F.lit("calls"))
    seeds = spark.createDataFrame([(3,)], "node long")
    return graph.impact(e, seeds, depth=4, per_kind=1_000_000, most_nodes=1_000_000).select("node", "distance")


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"""
)
def dead_nodes(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select(F.col("p_partkey").alias("node"))


@query(
    f"""WITH {EDGES}, k AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0), q AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size <= 10)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM q)"""
)
def edges_between(spark, sf_dir):
    """Edges whose ends are both in a set of nodes."""
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    p = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    return graph.subgraph(ships(spark, sf_dir), s.unionByName(p))


@query(
    f"""WITH {PAIRS}, e AS (SELECT file_a AS src, file_b AS dst, weight FROM pairs WHERE weight >= 2), s AS (SELECT p_partkey AS node, 1.0 / (1 + p_partkey) AS score FROM part WHERE p_partkey < 20),
 h1 AS (SELECT e.dst AS node, max(s.score * least(0.5 + least(e.weight, 10) * 0.05, 0.9) * 0.7) AS score FROM e JOIN s ON s.node = e.src GROUP BY 1),
 h2 AS (SELECT e.dst AS node, max(h1.score * least(0.5 + least(e.weight, 10) * 0.05, 0.9) * 0.7 * 0.7) AS score FROM e JOIN h1 ON h1.node = e.src GROUP BY 1)
SELECT node, round(max(score), 8) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1"""
)
def graph_search(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").filter("p_partkey < 20").select(F.col("p_partkey").alias("node"), (1.0 / (1 + F.col("p_partkey"))).alias("score"))
    return graph.graph_search(seeds, coupled(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query(
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'ships' END AS kind FROM lineitem)
SELECT dst AS node, kind, count(*) AS n, count(DISTINCT src) AS sources FROM e GROUP BY 1, 2"""
)
def find_references(spark, sf_dir):
    """References to nodes, grouped by kind."""
    kind = F.when(F.col("l_returnflag") == "R", "returns").otherwise("ships")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("node"), kind.alias("kind"))
    return rows.groupBy("node", "kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query("SELECT p_partkey AS node, p_type AS node_type, p_name AS name FROM part WHERE contains(lower(p_name), 'red') AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 200")
def query_nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter((F.col("p_type") == "ECONOMY") & F.contains(F.lower("p_name"), F.lit("red")))
    return p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("node_type"), F.col("p_name").alias("name")).orderBy("node").limit(200)


@query(
    """SELECT src, dst, sum(w)::BIGINT AS weight FROM (SELECT l_suppkey AS src, l_partkey AS dst, 1 AS w FROM lineitem
UNION ALL SELECT l_partkey, l_suppkey, 1 FROM lineitem) GROUP BY 1, 2"""
)
def weighted_increment(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("ships").alias("kind"), F.lit(1).cast("long").alias("weight"))
    return graph.increment(rows.limit(0), rows, undirected=True).select("src", "dst", "weight")

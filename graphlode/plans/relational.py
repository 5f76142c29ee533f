"""Plain relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.lineage import table
from graphlode.operators import resolve
from graphlode.plans import query


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP '2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"""
)
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_anti")


@query("SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect_parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    of = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("part"))
    return of("R").intersect(of("A"))


@query("SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def except_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("part")))


@query("SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(CAST(c_nationkey AS BIGINT), -1) AS nation, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("*")).alias("segment"), F.coalesce(F.col("c_nationkey").cast("long"), F.lit(-1)).alias("nation"), "n")


@query(
    """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS turn, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, o_orderkey - lag(o_orderkey) OVER w AS gap, ntile(4) OVER w AS quarter
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
)
def window_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("turn"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("gap"), F.ntile(4).over(w).cast("long").alias("quarter")
    )


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS t FROM part) WHERE t <= 5")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("t", F.row_number().over(w)).filter("t <= 5").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20")
def paged_top(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(40)


@query(
    """SELECT p_brand, mode AS dominant, round(top::DOUBLE / total, 6) AS share FROM (SELECT p_brand, p_type AS mode, c AS top, sum(c) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_type DESC) AS t
 FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY 1, 2)) WHERE t = 1"""
)
def dominant_value(spark, sf_dir):
    count = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("c"))
    return count.groupBy("p_brand").agg(F.max_by("p_type", F.struct("c", "p_type")).alias("dominant"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_files_per_target(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("SELECT o_orderpriority AS setting, count(*) AS usages, count(DISTINCT o_custkey) AS sites FROM orders GROUP BY 1")
def settings_usage(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("setting")).agg(F.count("*").alias("usages"), F.count_distinct("o_custkey").alias("sites"))


@query(
    """WITH a AS (SELECT 'Customer#' || lpad(CAST(x * 37 % 900 AS VARCHAR), 9, '0') AS ask, x FROM range(100) t(x))
SELECT ask, CASE WHEN count(DISTINCT c_custkey) = 0 THEN 'not_found' WHEN count(DISTINCT c_custkey) = 1 THEN 'unique' ELSE 'ambiguous' END AS status, min(c_custkey) AS node
FROM a LEFT JOIN customer c ON lower(ask) = lower(c_name) GROUP BY 1"""
)
def resolution_ladder(spark, sf_dir):
    asked = spark.range(100).select(F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 37 % 900).cast("string"), 9, "0")).alias("ask"))
    named = table(spark, sf_dir, "customer")
    rungs = [("id", F.col("ask"), F.col("c_custkey").cast("string"), 1.0), ("name", F.lower("ask"), F.lower("c_name"), 0.85)]
    return resolve.resolve(asked, "ask", named, "c_custkey", rungs).select("ask", "status", "node")


RANGES = """a AS (SELECT l_orderkey % 50 AS path, l_partkey % 997 AS s, l_partkey % 997 + l_linenumber AS e, l_orderkey * 10 + l_linenumber AS hit FROM lineitem),
 b AS (SELECT p_partkey % 50 AS path, p_partkey * 7 % 997 AS fs, p_partkey * 7 % 997 + p_size AS fe, p_partkey AS symbol FROM part)"""


def hits(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem")
    return a.select((F.col("l_orderkey") % 50).alias("path"), (F.col("l_partkey") % 997).alias("s"), (F.col("l_partkey") % 997 + F.col("l_linenumber")).alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit"))


def symbols(spark, sf_dir):
    start = F.col("p_partkey") * 7 % 997
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("path"), start.alias("fs"), (start + F.col("p_size")).alias("fe"), F.col("p_partkey").alias("symbol"))


@query(f"WITH {RANGES} SELECT hit, symbol FROM a JOIN b ON a.path = b.path AND s <= fe AND fs <= e")
def hit_symbol_range_join(spark, sf_dir):
    return resolve.overlap_pairs(hits(spark, sf_dir), symbols(spark, sf_dir), "path", ("s", "e"), ("fs", "fe"), 32).select("hit", "symbol")


@query(f"WITH {RANGES} SELECT hit, symbol FROM (SELECT hit, symbol, row_number() OVER (PARTITION BY hit ORDER BY fe - fs, symbol) AS t FROM a JOIN b ON a.path = b.path AND s BETWEEN fs AND fe) WHERE t = 1")
def innermost_function(spark, sf_dir):
    points = hits(spark, sf_dir).select("hit", "path", "s")
    best = resolve.innermost_at(points, symbols(spark, sf_dir), "path", "s", ("fs", "fe"), "symbol", 32)
    return points.join(best, ["path", "s"]).groupBy("hit").agg(F.min_by("symbol", F.struct("size", "symbol")).alias("symbol"))


@query(
    """WITH p AS (SELECT 'app/' || (c_custkey % 20) || '/' || (c_custkey % 7) || '/page' || c_custkey AS path FROM customer), r AS (SELECT 'app/' || x AS prefix, 'level' || x AS rule FROM range(10) t(x) UNION ALL SELECT 'app/' || x || '/3', 'deep' || x FROM range(20) t(x))
SELECT path, prefix, rule FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS t FROM p JOIN r ON path = prefix OR starts_with(path, prefix || '/')) WHERE t = 1"""
)
def longest_prefix_rule(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = lambda x: x.cast("string")
    items = c.select(F.concat(F.lit("app/"), s(F.col("c_custkey") % 20), F.lit("/"), s(F.col("c_custkey") % 7), F.lit("/page"), s(F.col("c_custkey"))).alias("path"))
    a = spark.range(10).select(F.concat(F.lit("app/"), s(F.col("id"))).alias("prefix"), F.concat(F.lit("level"), s(F.col("id"))).alias("rule"))
    b = spark.range(20).select(F.concat(F.lit("app/"), s(F.col("id")), F.lit("/3")).alias("prefix"), F.concat(F.lit("deep"), s(F.col("id"))).alias("rule"))
    return resolve.longest_prefix(items, "path", a.unionByName(b), "prefix").select("path", "prefix", "rule")


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 5 = 0)
SELECT k, round(v, 2) AS v FROM n UNION ALL SELECT k, round(v, 2) FROM o WHERE k NOT IN (SELECT k FROM n)"""
)
def upsert(spark, sf_dir):
    from graphlode.sources.tables import upserted

    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return upserted(old, new, ["k"]).withColumn("v", F.round("v", 2))


@query("SELECT k, generation, v FROM (SELECT o_custkey AS k, o_orderkey % 5 AS generation, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey DESC) AS t FROM orders) WHERE t = 1")
def latest_generation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("generation"), F.col("o_orderkey").alias("v"))
    return o.groupBy("k").agg(F.max(F.struct("generation", "v")).alias("m")).select("k", "m.generation", "m.v")


@query("SELECT namespace, generation, count(*) AS n FROM (SELECT o_orderstatus AS namespace, o_orderkey % 7 AS generation, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey % 7 DESC) AS t FROM orders) WHERE t <= 2 GROUP BY 1, 2")
def retention(spark, sf_dir):
    from graphlode.sources.tables import retained

    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("namespace"), (F.col("o_orderkey") % 7).alias("generation"))
    return retained(o, "keep_last", 2).groupBy("namespace", "generation").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS lang, coalesce(x, 0) AS lexical, coalesce(y, 0) AS vectors, abs(coalesce(x, 0) - coalesce(y, 0)) <= 100 AS ok FROM (SELECT lang AS k, count(*) AS x FROM documents GROUP BY 1) a FULL JOIN (SELECT CASE label % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'xx' END AS k, count(*) AS y FROM embeddings GROUP BY 1) b ON a.k = b.k")
def integrity_check(spark, sf_dir):
    from graphlode.sources.tables import integrity

    lang = F.when(F.col("label") % 4 == 0, "en").when(F.col("label") % 4 == 1, "fr").when(F.col("label") % 4 == 2, "de").otherwise("xx")
    return integrity(table(spark, sf_dir, "documents").select("lang"), table(spark, sf_dir, "embeddings").select(lang.alias("lang")), "lang")

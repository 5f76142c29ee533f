"""Change history: orders are changes, parts their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.lineage import table
from graphlode.operators import temporal
from graphlode.plans import query

PAIRS = """p AS (SELECT DISTINCT l_orderkey o, l_partkey f FROM lineitem),
 ok AS (SELECT o FROM p GROUP BY o HAVING count(*) <= 80),
 b AS (SELECT p.* FROM p SEMI JOIN ok ON p.o = ok.o),
 pairs AS (SELECT x.f AS file_a, y.f AS file_b, count(*) AS weight FROM b x JOIN b y ON x.o = y.o AND x.f < y.f GROUP BY 1, 2)"""
EDITED = [1, 2, 3, 5, 8, 13, 21, 34]
LIST = ", ".join(map(str, EDITED))


def files(spark, sf_dir):
    return temporal.change_files(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(f"WITH {PAIRS} SELECT file_a, file_b, weight FROM pairs WHERE weight >= 2")
def cochange_pairs(spark, sf_dir):
    return temporal.cochanges(files(spark, sf_dir)).filter("weight >= 2")


@query(f"WITH {PAIRS} SELECT file_a, file_b, weight FROM pairs WHERE weight >= 2 ORDER BY weight DESC, file_a, file_b LIMIT 100")
def cochange_top(spark, sf_dir):
    return temporal.top_couplings(temporal.cochanges(files(spark, sf_dir)), 2, 100)


@query(f"WITH {PAIRS} SELECT CASE WHEN file_a = 7 THEN file_b ELSE file_a END AS partner, weight FROM pairs WHERE (file_a = 7 OR file_b = 7) AND weight >= 1")
def couplings_of_file(spark, sf_dir):
    return temporal.couplings_of(temporal.cochanges(files(spark, sf_dir)), 7, 1)


@query(
    f"""WITH {PAIRS}, s AS (SELECT o, f AS seed FROM b WHERE f IN ({LIST}))
SELECT b.f AS file, count(*) AS weight, count(DISTINCT seed) AS seeds FROM b JOIN s ON b.o = s.o
WHERE b.f NOT IN ({LIST}) GROUP BY 1 HAVING count(*) >= 2 ORDER BY weight DESC, file LIMIT 50"""
)
def missing_companions(spark, sf_dir):
    return temporal.missing_companions(files(spark, sf_dir), EDITED, 2, 50)


@query(
    f"""WITH {PAIRS}, g AS (SELECT o AS change, sum((f IN ({LIST}))::INT)::BIGINT AS shared, count(*) AS size FROM b GROUP BY 1)
SELECT change, shared, size, round(shared::DOUBLE / (size + {len(EDITED)} - shared), 6) AS score FROM g WHERE shared > 0
ORDER BY shared::DOUBLE / (size + {len(EDITED)} - shared) DESC, change LIMIT 50"""
)
def similar_changes(spark, sf_dir):
    return temporal.similar_changes(files(spark, sf_dir), EDITED, 50).withColumn("score", F.round("score", 6))


REVERTS = """c AS (SELECT o_orderkey AS seq, o_custkey % 97 AS tree FROM orders)"""


@query(
    f"""WITH {REVERTS} SELECT a.seq AS "commit", b.seq + 1 AS undone FROM c a JOIN c b ON a.tree = b.tree
WHERE a.seq > b.seq + 1 AND a.seq - (b.seq + 1) <= 10"""
)
def revert_detection(spark, sf_dir):
    """A change whose tree is again the tree before one of the last ten: trees are stood in for by a column of few values."""
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 97).alias("tree"))
    near = commits.withColumn("slot", F.floor(F.col("seq") / 11))
    # Within reach of ten, commits lie in the same or the next slot; so equal trees meet only near each other.
    before = near.select((F.col("seq") + 1).alias("undone"), "tree", F.explode(F.array(F.floor((F.col("seq") + 1) / 11), F.floor((F.col("seq") + 1) / 11) + 1)).alias("slot"))
    held = near.select(F.col("seq").alias("commit"), "tree", "slot")
    return held.join(before, ["tree", "slot"]).filter("commit > undone AND commit - undone <= 10").select("commit", "undone")


@query(
    """WITH m AS (SELECT o_orderkey, 'Merge pull request #' || o_orderkey || ' from ' || CASE WHEN o_orderkey % 3 = 0 THEN 'fix' WHEN o_orderkey % 3 = 1 THEN 'feature' ELSE 'docs' END || '/x' AS message FROM orders)
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'fix' WHEN o_orderkey % 3 = 1 THEN 'feature' ELSE 'documentation' END AS kind, count(*) AS n, max(CAST(regexp_extract(message, '#([0-9]+)', 1) AS BIGINT)) AS last_number FROM m GROUP BY 1"""
)
def merged_requests(spark, sf_dir):
    from graphlode.sources.git import merged_requests as of

    name = F.when(F.col("o_orderkey") % 3 == 0, "fix").when(F.col("o_orderkey") % 3 == 1, "feature").otherwise("docs")
    message = F.concat(F.lit("Merge pull request #"), F.col("o_orderkey").cast("string"), F.lit(" from "), name, F.lit("/x"))
    commits = table(spark, sf_dir, "orders").select(message.alias("message"), F.unix_timestamp("o_orderdate").alias("time"), F.col("o_orderpriority").alias("file"))
    return of(commits).groupBy("kind").agg(F.count("*").alias("n"), F.max("number").alias("last_number"))


@query(
    """SELECT o_custkey AS author, count(*) AS changes, round(sum(o_totalprice), 2) AS churn, CAST(epoch(max(o_orderdate)) AS BIGINT) AS last_seen
FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1 ORDER BY changes DESC, author LIMIT 100"""
)
def author_activity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
    agg = o.groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("changes"), F.round(F.sum("o_totalprice"), 2).alias("churn"), F.unix_timestamp(F.max("o_orderdate").cast("timestamp")).alias("last_seen"))
    return agg.orderBy(F.desc("changes"), "author").limit(100)


@query(
    f"""WITH {PAIRS}, n AS (SELECT count(DISTINCT o) AS n FROM b), c AS (SELECT f, count(*) AS c FROM b GROUP BY 1)
SELECT file_a, file_b, weight, round(weight::DOUBLE / x.c, 6) AS confidence, round(weight::DOUBLE * n.n / (x.c * y.c), 6) AS lift
FROM pairs JOIN c x ON file_a = x.f JOIN c y ON file_b = y.f CROSS JOIN n WHERE weight >= 3"""
)
def coupling_lift(spark, sf_dir):
    held = files(spark, sf_dir)
    count = held.groupBy("file").agg(F.count("*").alias("c"))
    n = held.agg(F.count_distinct("change").alias("n"))
    pairs = temporal.cochanges(held).filter("weight >= 3")
    rows = pairs.join(count.toDF("file_a", "ca"), "file_a").join(count.toDF("file_b", "cb"), "file_b").crossJoin(F.broadcast(n))  # n: one row
    return rows.select("file_a", "file_b", "weight", F.round(F.col("weight") / F.col("ca"), 6).alias("confidence"), F.round(F.col("weight") * F.col("n") / (F.col("ca") * F.col("cb")), 6).alias("lift"))

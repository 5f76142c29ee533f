"""History mining: co-change, missing companions, similar changes, reverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.lineage import dealt

LARGEST_CHANGE = 80
MOST = 4294967295  # weights saturate here


def change_files(rows: DataFrame, change: str, file: str, most: int = LARGEST_CHANGE) -> DataFrame:
    """Distinct files of each change, without bulk changes.

    One shuffle by change serves the distinct, the count and the self-join that follows.
    """
    pairs = dealt(rows.select(F.col(change).alias("change"), F.col(file).alias("file")), "change").distinct()
    n = F.count("*").over(Window.partitionBy("change"))
    return pairs.withColumn("n_files", n).filter(F.col("n_files") <= most).drop("n_files")


def cochanges(files: DataFrame) -> DataFrame:
    """``file_a`` < ``file_b`` and the number of changes that hold both.

    A change has a bounded number of files, so pairs are linear in the history.
    """
    sets = files.groupBy("change").agg(F.array_sort(F.collect_list("file")).alias("files"))
    heads = sets.select("files", F.posexplode("files").alias("at", "file_a"))
    pairs = heads.select("file_a", F.explode(F.expr("slice(files, at + 2, size(files))")).alias("file_b"))
    return dealt(pairs, "file_a", "file_b", mb=0.5).groupBy("file_a", "file_b").agg(F.least(F.count("*"), F.lit(MOST)).alias("weight"))


def top_couplings(pairs: DataFrame, least: int, k: int) -> DataFrame:
    return pairs.filter(F.col("weight") >= least).orderBy(F.desc("weight"), "file_a", "file_b").limit(k)


def couplings_of(pairs: DataFrame, file, least: int) -> DataFrame:
    """Partners of one file, strongest first."""
    other = F.when(F.col("file_a") == file, F.col("file_b")).otherwise(F.col("file_a"))
    held = pairs.filter(((F.col("file_a") == file) | (F.col("file_b") == file)) & (F.col("weight") >= least))
    return held.select(other.alias("partner"), "weight").orderBy(F.desc("weight"), "partner")


def missing_companions(files: DataFrame, edited: list, least: int, k: int) -> DataFrame:
    """Partners of edited files that were not edited, by the evidence of past changes."""
    seeds = files.filter(F.col("file").isin(edited)).select("change", F.col("file").alias("seed"))
    partners = files.join(seeds, "change").filter(~F.col("file").isin(edited))
    return (
        partners.groupBy("file").agg(F.count("*").alias("weight"), F.count_distinct("seed").alias("seeds")).filter(F.col("weight") >= least).orderBy(F.desc("weight"), "file").limit(k)
    )


def similar_changes(files: DataFrame, planned: list, k: int) -> DataFrame:
    """Past changes by Jaccard overlap with a planned set of files."""
    inside = F.col("file").isin(planned)
    per = files.groupBy("change").agg(F.count_if(inside).alias("shared"), F.count("*").alias("size"))
    score = F.col("shared") / (F.col("size") + F.lit(len(set(planned))) - F.col("shared"))
    return per.filter("shared > 0").select("change", "shared", "size", score.alias("score")).orderBy(F.desc("score"), "change").limit(k)


def reverted_commit(message: Column) -> Column:
    """The commit that a message says it reverts; empty if none."""
    return F.regexp_extract(message, r"This reverts commit ([0-9a-f]{7,40})", 1)


def tree_reverts(commits: DataFrame, reach: int = 10) -> DataFrame:
    """Commits whose tree equals the tree before a commit of the last ``reach``.

    ``commits`` has (seq, tree).  Equal trees are an equi-join; distance is checked within.
    """
    before = commits.select((F.col("seq") + 1).alias("undone"), F.col("tree"))  # the tree before commit ``undone``
    held = commits.select(F.col("seq").alias("commit"), "tree")
    return held.join(before, "tree").filter((F.col("commit") > F.col("undone")) & (F.col("commit") - F.col("undone") <= reach)).select("commit", "undone")


def latest_before(events: DataFrame, key: str, order: list[str], cutoff: Column, time: str) -> DataFrame:
    """For each key the last event strictly before a time."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.filter(F.col(time) < cutoff).withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")

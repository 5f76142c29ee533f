"""Stores as Parquet: upserts, generations, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` in place of rows of ``old`` with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_slices(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(spark: SparkSession, root: str, df: DataFrame, generation: int) -> None:
    """Write a generation in full, then point at it; readers see the old or the new one, never a part.

    A pointer is an empty folder named by its turn and generation, made in one step and never changed.
    """
    df.write.mode("overwrite").parquet(f"{root}/generation={generation}")
    turn = max((t for t, _ in pointers(spark, root)), default=0) + 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers/{turn}-{generation}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def pointers(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(turn, generation) of every publication, in order: a few for each retained generation."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(tuple(map(int, n.split("-"))) for n in names)


def active(spark: SparkSession, root: str, pinned: int | None = None) -> DataFrame:
    """The generation published last, or the one that a reader has pinned."""
    generation = pointers(spark, root)[-1][1] if pinned is None else pinned
    return spark.read.parquet(f"{root}/generation={generation}")


def visible(rows: DataFrame, generation: int, policy: str, key: str) -> DataFrame:
    """Rows of a generation under a namespace policy."""
    if policy == "snapshot":
        return rows.filter(F.col("generation") == generation)
    if policy == "append_only":
        return rows.filter(F.col("generation") <= generation)
    if policy == "global":
        w = Window.partitionBy(key).orderBy(F.desc("generation"))
        return rows.withColumn("turn_", F.row_number().over(w)).filter("turn_ = 1").drop("turn_")
    raise ValueError(policy)


def retained(rows: DataFrame, policy: str, last: int = 1) -> DataFrame:
    """What retention keeps: all, the latest or the last few generations of a namespace."""
    if policy == "forever":
        return rows
    w = Window.partitionBy("namespace").orderBy(F.desc("generation"))
    keep = 1 if policy == "keep_latest" else last
    gens = rows.select("namespace", "generation").distinct().withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= keep).select("namespace", "generation")
    return rows.join(gens, ["namespace", "generation"], "left_semi")


def missing_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents without a cached vector."""
    return chunks.select("content_hash", "content").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")


def integrity(lexical: DataFrame, vectors: DataFrame, by: str, margin: int = 100) -> DataFrame:
    """Counts of both stores per namespace, and whether they differ by more than the margin."""
    a = lexical.groupBy(by).agg(F.count("*").alias("lexical"))
    b = vectors.groupBy(by).agg(F.count("*").alias("vectors"))
    rows = a.join(b, by, "full_outer").na.fill(0, ["lexical", "vectors"])
    return rows.withColumn("ok", F.abs(F.col("lexical") - F.col("vectors")) <= margin)

"""Tables of a folder, and cut lineage for iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Only a session whose driver is its only process may do without: it gets a folder of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            where = "file://" + tempfile.mkdtemp(prefix="graphlode-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def dealt(df: DataFrame, *by: str, mb: float = 1.0) -> DataFrame:
    """``df`` dealt by some columns to as many tasks as its plan's estimate has ``mb``.

    Spark joins small shuffle partitions until there are about as many as cores, so what a task makes
    of its rows would grow with the input; a number that is asked for stays.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(spark.sparkContext.defaultParallelism, min(10_000, -(-size // int(mb * (1 << 20)))))
    return df.repartition(n, *by)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the folder that all executors share and go on from the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphlode/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, by: str, name: str = "step") -> DataFrame:
    """``cut`` to ``n`` buckets of a column: what meets the written table by that column is shuffled, not the table.

    Spark knows buckets of tables only, so there is one in the catalogue while this runs; its files are in the shared folder.
    """
    spark = df.sparkSession
    key = f"{name}-{uuid.uuid4().hex}"
    path, known = f"{shared_dir(spark)}/graphlode/{key}", "graphlode_" + key.replace("-", "_")
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", path).saveAsTable(known)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    written = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # an external table: its files stay
    return written


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions by hash an int that goes there, so ``n`` groups fill one each."""
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key"))
    return [r.key for r in rows.collect()]

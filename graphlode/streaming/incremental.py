"""Streams over files and events.

Watermarks, windows and deduplication are additions for event time; the change
set, the co-change accumulator and the debounce keep the semantics of the batch
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.operators.resolve import changed
from graphlode.operators.temporal import LARGEST_CHANGE, change_files, cochanges
from graphlode.sources.tables import upserted


def events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of one key, closed after a silence: a trailing debounce."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), key).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, table: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there, into a table in memory (for tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


class ChangeSet:
    """``foreachBatch`` sink: rows whose fingerprint is new or differs go to the index; the fingerprints follow."""

    def __init__(self, fingerprints: str, index: str, key: str = "path", marks: tuple = ("size", "mtime", "content_hash")):
        self.fingerprints, self.index, self.key, self.marks = fingerprints, index, key, list(marks)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = self._read(spark, self.fingerprints, batch.select(self.key, *self.marks).schema)
        marks = batch.select(self.key, *self.marks)
        status = changed(old, marks, self.key, self.marks).filter("status IN ('added', 'modified')")
        fresh = batch.join(status.select(self.key), self.key, "left_semi").withColumn("epoch", F.lit(epoch))
        fresh.write.mode("append").parquet(self.index)
        upserted(old, marks, [self.key]).write.mode("overwrite").parquet(f"{self.fingerprints}/v={epoch}")

    def _read(self, spark, path, schema):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            return spark.createDataFrame([], schema)
        latest = max((s.getPath().toString() for s in fs.listStatus(jpath) if "v=" in s.getPath().getName()), key=lambda p: int(p.rsplit("v=", 1)[1]))
        return spark.read.schema(schema).parquet(latest)


class CochangeTotals:
    """``foreachBatch`` sink: adds the pairs of a batch of changes to the totals."""

    def __init__(self, path: str, most: int = LARGEST_CHANGE):
        self.path, self.most = path, most

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        pairs = cochanges(change_files(batch, "change", "file", self.most))
        pairs.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/epoch_={epoch}")

    def totals(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/epoch_=*").groupBy("file_a", "file_b").agg(F.sum("weight").alias("weight"))

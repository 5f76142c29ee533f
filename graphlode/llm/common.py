"""What the corpus operators share: document normalisation and cut lineage.

Conventions that hold for every operator of this subpackage, unless its
docstring says otherwise:

* ``docs`` is any DataFrame with ``doc_id`` and ``text``; other columns, whatever
  their names, are ignored or carried through untouched.
* A null text is the empty text.
* A null ``doc_id`` is one document key that sorts before all others; it comes
  back as null.
* Rows that share a ``doc_id`` are each returned; for statistics over documents
  they count as one document.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

NO_ID = -(1 << 63)
KIB, MIB = 1 << 10, 1 << 20


def bodies(docs: DataFrame, *also) -> DataFrame:
    """``k`` (document key, never null), ``body`` (UTF-8 bytes, never null) and further columns."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("body"),
        *also,
    )


def doc_id(k: str = "k"):
    """The column ``doc_id`` that belongs to a document key."""
    return F.when(F.col(k) != NO_ID, F.col(k)).alias("doc_id")


def stash(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and return the written table.

    The table survives the loss of any executor.  It is removed when the driver ends.
    ``few`` is for tables that are small beside the shuffle that makes them: they are
    dealt anew by their measured size, so there are as many files as they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphlode/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(key: str, make):
    """An object that a Python worker builds once and keeps for its later tasks."""
    held = sys.modules.setdefault("_graphlode_worker", types.ModuleType("_graphlode_worker"))
    if not hasattr(held, key):
        setattr(held, key, make())
    return getattr(held, key)


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most ``rows``, so Python objects exist for a part at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def annotate(docs: DataFrame, fn, fields: str, carry=("doc_id",)) -> DataFrame:
    """``row`` (a struct of the carried columns), ``k`` and ``fields``, which ``fn`` makes from a list of bodies.

    ``fn`` returns one list of values per field.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = T.StructType.fromDDL(fields)
    kinds, names = [to_arrow_type(f.dataType) for f in added], ["row", "k", *added.names]

    def run(batches):
        for batch in slices(batches):
            columns = fn(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    source = bodies(docs, F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")).select("row", "k", "body")
    schema = T.StructType([source.schema["row"], T.StructField("k", T.LongType()), *added])
    return source.mapInArrow(run, schema)

"""Inverted indexes as Parquet: postings of words, and of trigrams for literal search.

An index is a folder of tables partitioned by ``bucket``, a hash of the term, so a
search reads the buckets of its own terms and nothing else; a fixed number of
buckets keeps files large.  Document lengths are a table beside it.  Postings of a
document are replaced by rewriting the rows of its key, and a search over an index
gives the rows of a search over the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.functions import text as tx
from graphlode.lineage import dealt
from graphlode.operators import retrieval

BUCKETS = 64


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, key: str, text: str, tokens=tx.words) -> DataFrame:
    """(``key``, ``term``, ``tf``, ``len``), one row for each distinct term of a document."""
    # Documents are dealt by key, so their terms are counted where they are and shuffled once, to their buckets.
    rows = dealt(docs.select(key, text), key).select(F.col(key), tokens(F.col(text)).alias("all")).select(key, F.size("all").alias("len"), F.explode("all").alias("term"))
    return rows.groupBy(key, "term", "len").agg(F.count("*").cast("int").alias("tf")).select(key, "term", "tf", "len")


def grams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``term``): the distinct trigrams of each document."""
    return docs.select(F.col(key), F.explode(F.array_distinct(tx.trigrams(F.col(text)))).alias("term"))


def write(rows: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write postings, each bucket by one task and sorted by term, so a bucket's row groups skip by term too."""
    of = rows.withColumn("bucket", bucket_of(F.col("term"), buckets))
    of.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(path)


def write_lengths(docs: DataFrame, key: str, text: str, path: str, tokens=tx.words) -> None:
    docs.select(F.col(key), F.size(tokens(F.col(text))).alias("len")).write.mode("overwrite").parquet(path)


def replace(held: DataFrame, rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``held`` without the documents of ``keys``, and ``rows`` (their new postings) beside it."""
    return held.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def of_terms(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of a query's terms: its buckets are pruned, its terms pushed to the scan."""
    terms = list(dict.fromkeys(terms))
    asked = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(asked) & F.col("term").isin(terms))


def bm25(found: DataFrame, lengths: DataFrame, key: str, terms: Sequence[str], mode: str = "any") -> DataFrame:
    """``key`` and ``score`` from the postings of ``terms``; statistics are a row, document frequencies a row per term."""
    terms = list(dict.fromkeys(terms))
    stats = lengths.filter("len > 0").agg(F.count("*").alias("n"), F.avg(F.col("len").cast("double")).alias("mean_len"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # as many rows as query terms; one row
    tf, length = F.col("tf"), F.col("len") / F.col("mean_len")
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * length))
    hits = rows.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("found"))
    return (hits.filter(F.col("found") == len(terms)) if mode == "all" else hits).select(key, "score")


def narrowed(spark: SparkSession, path: str, key: str, literal: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys of the documents that hold every trigram of ``literal``, by intersecting their postings."""
    wanted = sorted({literal[i : i + 3] for i in range(len(literal) - 2)})
    if not wanted:
        raise ValueError("a literal of three characters or more is needed")
    return of_terms(spark, path, wanted, buckets).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(key)


def grep(docs: DataFrame, path: str, key: str, text: str, literal: str, buckets: int = BUCKETS) -> DataFrame:
    """Lines that hold ``literal``: candidates by trigrams, then the lines themselves."""
    held = docs.join(narrowed(docs.sparkSession, path, key, literal, buckets), key, "left_semi")
    return retrieval.lines(held, key, text).filter(F.contains("line", F.lit(literal)))


def multiline(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Matches that may cross lines: (``key``, ``turn``, ``first_line``, ``last_line``, ``match``), none overlapping another."""
    regex = retrieval.smart_case(retrieval.check_pattern(pattern))
    held = docs.filter(F.col(text).rlike(regex)).select(F.col(key), F.col(text).alias("rest_"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))).alias("turn", "match"))
    # What stands before a match is what the text holds before its turn-th split.
    parts = F.split("rest_", regex)
    before = F.concat(F.array_join(F.slice(parts, 1, F.col("turn") + 1), ""), F.array_join(F.slice(F.regexp_extract_all("rest_", F.lit(regex), F.lit(0)), F.lit(1), F.col("turn")), ""))
    breaks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = held.select(key, "turn", "match", (breaks(before) + 1).cast("long").alias("first_line"))
    return rows.select(key, F.col("turn").cast("long").alias("turn"), "first_line", (F.col("first_line") + breaks(F.col("match"))).cast("long").alias("last_line"), "match")

"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages before
the last return the columns of ``docs``.  Each is written as Parquet and read
again as the documents of the next.

Rows that share a ``doc_id`` are one document to every stage: they stay or go
together, so equal rows of one id are all packed.  Null texts fail the quality
rules; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.llm import decontaminate, linededup, minhash, packing, qualityrules
from graphlode.llm.common import NO_ID, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule or an adaptive threshold rejects go."""
    return qualityrules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but the last of them; ``n_chars`` follows the text."""
    found = linededup.dedup_lines(docs, carry=[c for c in docs.columns if c != "text"])
    text = F.col("kept").cast("string")
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return found.select(*(changed[c] if c in changed else F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five words, 0.8) stays."""
    found = minhash.near_duplicates(docs)
    stay = found.filter("k = component").select("k").distinct()
    return docs.join(stay, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == stay["k"], "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of any benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark, most_items=0, carry=docs.columns).filter("NOT contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The stages sketch, hash and tokenize, which SQL cannot express; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline against a plain version of its stages."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline
from graphlode.llm import qualityrules

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    if not os.path.exists(SMALL):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    good = stages["quality_rules"](spark, docs, SMALL)
    assert good.columns == docs.columns
    kept = {r.k for r in qualityrules.quality_rules(docs).filter("kept").collect()}
    failed = {k for k, t in rows(docs) if brute.quality(t)[-1]}
    assert {k for k, _ in rows(good)} == kept and not kept & failed

    lines = stages["line_dedup"](spark, good, SMALL)
    assert lines.columns == docs.columns
    assert rows(lines) == sorted((k, t) for k, _, _, t in brute.line_dedup(rows(good)))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["minhash_near_dedup"](spark, lines, SMALL)
    label = brute.near(rows(lines), 5)
    assert near.columns == docs.columns
    assert rows(near) == [(k, t) for k, t in rows(lines) if label[k][1] == k]

    clean = stages["benchmark_decontamination"](spark, near, SMALL)
    bad = {k for k, _, _, n, *_ in brute.contamination(rows(near), items) if n}
    assert clean.columns == docs.columns
    assert rows(clean) == [(k, t) for k, t in rows(near) if k not in bad]

    packed = stages["packing"](spark, clean, SMALL).collect()
    assert {r.doc_id for r in packed} == {k for k, _ in rows(clean)}
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "doc_tokens").filter("start = 0").collect()))
    assert whole == sorted((r.doc_id, 0, r.doc_tokens) for r in packed if r.start == 0)


def test_a_passage_of_one_item_goes(spark, tmp_path):
    items = [(i, " ".join(f"q{i}w{j}" for j in range(20))) for i in range(3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda i: " ".join(f"d{i}w{j}" for j in range(30))
    rows = [(1, own(1)), (2, f"{own(2)} {' '.join(items[0][1].split()[4:12])} {own(20)}"), (3, f"{own(3)} {' '.join(items[1][1].split()[:7])}"), (4, f"{items[1][1]} {items[2][1]}"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_and_nulls(spark):
    rows = [(i, f"{i} " + "some words that differ from each other by number " * 2 + " ".join(f"w{i}x{j}" for j in range(80)), None, None, 1, True) for i in range(30)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k long, kept boolean")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SMALL)
        assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(30))

"""Written indexes and flows on small rows, with nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from graphlode.operators import flows, index, retrieval, review
from graphlode.sources import tables

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (5, "Délta béta \U0001f600xyz")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc long, text string")


def test_postings_and_search(spark, docs, tmp_path):
    rows = {(r.doc, r.term): (r.tf, r.len) for r in index.postings(docs, "doc", "text").collect()}
    assert rows[1, "beta"] == (2, 3) and rows[2, "gamma"] == (1, 2) and not any(k in (3, 4) for k, _ in rows)
    index.write(index.postings(docs, "doc", "text"), f"{tmp_path}/t", buckets=4)
    index.write_lengths(docs.filter("text IS NOT NULL"), "doc", "text", f"{tmp_path}/l")
    for terms, mode in ((["beta"], "any"), (["beta", "gamma"], "any"), (["beta", "gamma"], "all"), (["none"], "any")):
        found = index.of_terms(spark, f"{tmp_path}/t", terms, 4)
        got = {r.doc: round(r.score, 9) for r in index.bm25(found, spark.read.parquet(f"{tmp_path}/l"), "doc", terms, mode).collect()}
        want = {r.doc: round(r.score, 9) for r in retrieval.bm25(docs, "doc", "text", terms, mode).collect()}
        assert got == want
    assert "bucket" in index.of_terms(spark, f"{tmp_path}/t", ["beta"], 4)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_trigrams_narrow_and_grep(spark, docs, tmp_path):
    index.write(index.grams(docs, "doc", "text"), f"{tmp_path}/g", buckets=4)
    assert [r.doc for r in index.narrowed(spark, f"{tmp_path}/g", "doc", "gamma", 4).collect()] == [2]
    assert [(r.doc, r.line_no) for r in index.grep(docs, f"{tmp_path}/g", "doc", "text", "\U0001f600xy", 4).collect()] == [(5, 1)]
    with pytest.raises(ValueError):
        index.narrowed(spark, f"{tmp_path}/g", "doc", "ab")


def test_multiline_places(spark):
    docs = spark.createDataFrame([(1, "a\nb end\nStart x\nend\nStart")], "doc long, text string")
    got = [(r.turn, r.first_line, r.last_line) for r in index.multiline(docs, "doc", "text", r"end\nStart").orderBy("turn").collect()]
    assert got == [(0, 2, 3), (1, 4, 5)]


def test_pointers_and_pins(spark, tmp_path):
    for g in (1, 2):
        tables.publish(spark, str(tmp_path), spark.range(g), g)
    assert tables.active(spark, str(tmp_path)).count() == 2 and tables.active(spark, str(tmp_path), pinned=1).count() == 1
    tables.publish(spark, str(tmp_path), spark.range(1), 1)  # back to the former one
    assert tables.active(spark, str(tmp_path)).count() == 1


def test_value_flow_of_a_cycle(spark):
    links = spark.createDataFrame([(1, 2, "call"), (2, 3, "assign"), (3, 1, "call"), (9, 9, "call")], "src long, dst long, via string")
    got = {(r.root, r.node): (r.steps, r.via) for r in flows.value_flow(links, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 1): (0, None), (1, 2): (1, "call"), (1, 3): (2, "assign")}


def test_affinity_leaves_out_wide_methods(spark):
    rows = [(m, f"s{k}") for m in (1, 2) for k in (1, 2, 2)] + [(3, f"s{k}") for k in range(50)] + [(4, "s1")]
    got = flows.state_affinity(spark.createDataFrame(rows, "method long, state string")).collect()
    assert [tuple(r) for r in got] == [("s1", "s2", 2)]


def test_builtin_names(spark):
    names = spark.createDataFrame([("::CStr(x)",), ("My.IIf",), ("Other.Name",), (None,)], "name string")
    assert [r.b for r in names.select(flows.is_builtin(F.col("name")).alias("b")).collect()] == [True, True, False, None]


def test_rules_in_one_pass_and_by_join(spark):
    lines = spark.createDataFrame([(1, "src/A.vb", 1, "Dim x = Eval(y)"), (1, "src/B.cs", 2, "eval(z)"), (2, "doc.md", 1, None)], "change long, file string, line_no long, line string")
    rules = spark.createDataFrame([("no eval", "(?i)eval\\(", "", "critical"), ("vb only", "Dim", ".VB", "warning"), ("broken", None, "", "warning")], "rule string, pattern string, scope string, severity string")
    one, joined = (sorted(map(tuple, review.repo_rules(lines, rules, listed=n).collect())) for n in (500, 0))
    assert one == joined and len(one) == 3

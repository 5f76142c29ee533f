"""Legacy pages, slices, findings, literal search and git patches on small rows, with nulls and empty tables."""

import subprocess

from pyspark.sql import functions as F

from graphlode.functions import paths
from graphlode.operators import extract, graph, legacy, planning, retrieval
from graphlode.sources import git, memory


def test_empty_and_null_files(spark):
    for rows in ([], [("a", None), ("b", "")]):
        held = spark.createDataFrame(rows, "path string, content string")
        for fn in (legacy.bridge, legacy.map_parts, legacy.classic, legacy.control_targets):
            assert fn(held).count() == 0


def test_classic_reads_server_blocks_only(spark):
    page = """Session("markup") <script runat="server">Function F(a)
Session('w') = 1
x = Application("r")
</script><% c.CommandText = "UPDATE [Users] SET a" %>"""
    got = {(r.kind, r.name) for r in legacy.classic(spark.createDataFrame([("p", page)], "path string, content string")).collect()}
    assert got == {("function", "F"), ("state_write", "w"), ("state_read", "r"), ("sql", "UPDATE [Users] SET a"), ("table", "users")}


def test_slice_stops_at_dead_nodes(spark):
    edges = spark.createDataFrame([(1, 2, "contains"), (2, 3, "contains"), (3, 4, "contains"), (1, 5, "reads"), (2, 1, "contains"), (5, 6, "contains")], "src long, dst long, kind string")
    nodes = spark.createDataFrame([(i, i == 3) for i in range(1, 7)], "node long, dead boolean")
    got = {(r["class"], r.node, r.depth) for r in legacy.migration_slice(edges, nodes, 1, ["contains"], {"contains": "part"}).collect()}
    assert got == {("part", 2, 1), ("other", 5, 1), ("part", 3, 2), ("part", 1, 2)}
    assert legacy.migration_slice(edges, nodes, 99, ["contains"], {"contains": "part"}).count() == 0


def test_coverage_of_equalities_and_ranges(spark):
    wanted = spark.createDataFrame([("t", ["b", "a"], ["c"]), ("t", ["a"], ["c"]), ("t", ["c"], []), ("u", ["a"], [])], "table_name string, equals array<string>, then array<string>")
    held = spark.createDataFrame([("t", ["a", "b", "c"]), ("u", [])], "table_name string, columns array<string>")
    got = {(r.table_name, tuple(r.equals), tuple(r.then)) for r in legacy.uncovered(wanted, held).collect()}
    assert got == {("t", ("a",), ("c",)), ("t", ("c",), ()), ("u", ("a",), ())}


def test_exports_and_rules(spark):
    text = '{"issues": [{"rule": "r", "severity": "BLOCKER", "component": "p:a/b.cs", "line": 3, "message": "m"}, {"severity": "HIGH", "message": "n"}, {"severity": "HIGH", "component": "p:a/b.cs"}]}'
    found = memory.findings_from_export(spark.createDataFrame([(text,), (text,), ("none",), (None,)], "t string"), "t")
    assert {(r.severity, r.file, r.message) for r in found.collect()} == {("blocker", "a/b.cs", "m"), ("high", None, "n")} and found.count() == 2
    assert [(r.rule, r.scope, r.findings) for r in memory.promoted_rules(found).collect()] == [("m", "a/", 1)]


def test_literal_search(spark):
    docs = spark.createDataFrame([(1, "photo projekt"), (2, "photoprojekt"), (3, None), (4, "Foto"), (5, "user photo id"), (6, "photo user id")], "doc long, text string")
    find = lambda q, mode: {r.doc: r.score for r in retrieval.literal_search(docs, "doc", "text", q, mode).collect()}
    assert set(find("photo", "loose")) == {1, 2, 5, 6} and find("photo", "loose")[1] > find("photo", "loose")[2] > 0
    assert set(find("photo projekt", "strict")) == {1, 2} and set(find("oto", "loose")) == set() and set(find("oto", "regex")) == {1, 2, 4, 5, 6}
    assert set(find("user_photo", "loose")) == {5}  # runs of one word follow each other
    assert find("", "loose") == {} and find("--", "strict") == {} and find("ab", "regex") == {}
    assert set(find("(projekt)", "regex")) == set()


def test_story_concepts_and_plan(spark):
    assert planning.story_concepts("As an admin I would like to set minimum photos, photos required everywhere") == ["minimum", "photos", "required"]
    items = spark.createDataFrame([(1, "g", "photos"), (2, "g", "other")], "item long, grp string, name string")
    pairs = spark.createDataFrame([(1, 2, 3)], "file_a long, file_b long, weight long")
    got = {tuple(r) for r in planning.story_plan(items, ["photos"], "item", "grp", "name", pairs).collect()}
    assert got == {("photos", 1, 3.0), ("coupled", 2, 3.0)}
    assert planning.story_plan(items, [], "item", "grp", "name", pairs).count() == 0


def test_places_declarations_cookies_headers(spark):
    nodes = spark.createDataFrame([(i * 3,) for i in range(100)], "node long")
    assert graph.at_places(nodes, [0, 25, 99]) == [0, 75, 297] and graph.at_places(nodes.limit(0), []) == []
    code = spark.createDataFrame([("a", "python", "def f():\nclass C:"), ("b", "sql", "CREATE TABLE dbo.T (x int)"), ("c", "none", "def g():"), ("d", None, "x")], "path string, language string, content string")
    assert {tuple(r) for r in extract.declarations(code).collect()} == {("a", "function", "f"), ("a", "class", "C"), ("b", "table", "T")}
    state = spark.createDataFrame([("a", 'Request.Cookies["k"] Response.Cookies("w") Session("s") = 1')], "path string, content string")
    assert {(r.store, r.state, r.access) for r in extract.state_accesses(state).collect()} == {("cookie", "k", "read"), ("cookie", "w", "write"), ("session", "s", "write")}
    heads = spark.createDataFrame([("// <Auto-Generated>\nx",), ("x\n" * 30 + "do not edit",)], "c string")
    assert [r[0] for r in heads.select(paths.has_generated_header(F.col("c"))).collect()] == [True, False]


def test_patches_and_backfill(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    for i in range(3):
        (tmp_path / "å file.txt").write_text("line\n" * 3 + f"é{i}\n")
        (tmp_path / f"n{i}.txt").write_text(f"n{i}\n")
        run("add", ".")
        run("commit", "-q", "-m", f"c{i}")
    (tmp_path / "n0.txt").unlink()
    run("commit", "-q", "-am", "gone")
    head = run("rev-parse", "HEAD")
    spark.dataSource.register(git.GitDiffSource)
    spark.dataSource.register(git.GitSource)
    rows = spark.read.format("gitdiff").option("per_task", 2).load(str(tmp_path)).collect()
    assert len(rows) == 7 and sum(r.file == "å file.txt" for r in rows) == 3 and [r.file for r in rows if r.commit == head] == ["n0.txt"]
    assert any("+é2\n" in r.patch and "-é1\n" in r.patch for r in rows)
    short = spark.read.format("gitdiff").option("most_bytes", 60).load(str(tmp_path)).collect()
    assert len(short) == 7 and all(len(r.patch.encode()) <= 60 and r.patch.endswith(git.TRUNCATED) for r in short)
    older = {r.commit for r in spark.read.format("gitlog").option("before", "HEAD~1").load(str(tmp_path)).collect()}
    assert older == set(run("rev-list", "HEAD~2").split())


def test_cut_patch_between_characters():
    assert git.cut_patch(b"abc", 3) == "abc" and git.cut_patch("é".encode() * 20, 22).encode() == "é".encode() * 2 + git.TRUNCATED.encode()
    assert git.cut_patch(b"abcdef", 4) == git.TRUNCATED[:4]

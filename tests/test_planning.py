"""Planning, migration and embedding operators on small cases."""

import numpy as np
from pyspark.sql import functions as F

from graphlode.operators import embed, migration, planning


def test_question_plan():
    p = planning.plan_question("Where is `SaveOrder` called and why does src/Orders/Save.vb not log?")
    assert p["intents"] == ["location", "reason"] and "SaveOrder" in p["entities"] and p["paths"] == ["src/Orders/Save.vb"] and p["negated"]
    assert planning.plan_question("hello")["intents"] == ["general"]
    assert planning.stem("Notifications") == "notific" and planning.stem("as") == "as"


def test_footprint_ranks_before_the_cap(spark):
    items = spark.createDataFrame([(1, "data", "order_backup"), (2, "data", "reorder"), (3, "data", "orders"), (4, "ui", "OrderPage")], "id int, layer string, name string")
    got = planning.footprint(items, "orders", "id", "layer", "name", 2).collect()
    assert {(r.layer, r.id, r.total) for r in got} == {("data", 3, 3), ("data", 1, 3), ("ui", 4, 1)}


def test_change_set_keeps_broad_arms_out(spark):
    f = lambda *r: spark.createDataFrame(list(r), "file string, score double")
    got = {r.file: (r.arms, r.is_primary) for r in planning.change_set({"coupling": (f(("a", 1.0), ("b", 0.5)), 1.0), "terms": (f(("c", 99.0), ("a", 1.0)), 0.2)}, 1).collect()}
    assert got == {"a": ("coupling,terms", True), "b": ("coupling", False), "c": ("terms", False)}


def test_guards_reach_one_helper(spark):
    calls = spark.createDataFrame([("page", "helper"), ("helper", "check"), ("other", "log"), ("far", "page")], "caller string, callee string")
    functions = spark.createDataFrame([(x,) for x in ("page", "helper", "other", "far", "alone")], "function string")
    got = {r.function: r.status for r in planning.guard_status(functions, calls, spark.createDataFrame([("check",)], "guard string")).collect()}
    assert got == {"page": "guarded", "helper": "guarded", "other": "unguarded", "far": "unguarded", "alone": "unknown"}


def test_lexicon_and_evidence(spark):
    pairs = spark.createDataFrame([("k", "en", "Order"), ("k", "sv", "Beställning")], "resource string, language string, value string")
    assert {(r.term, r.translation) for r in planning.lexicon(pairs).collect()} == {("order", "beställning"), ("beställning", "order")}
    rows = spark.createDataFrame([(1, "k", "p", 0.5), (2, "k", "q", 0.9), (3, "m", "q", 0.7)], "id int, key string, path string, score double")
    assert [r.id for r in planning.dedup_evidence(rows, "key").collect()] == [2]
    assert spark.createDataFrame([("red fox",)], ["t"]).select(planning.corroboration(F.col("t"), ["red", "fox", "dog"])).first()[0] == 0.5


def test_migration_rules(spark):
    lines = spark.createDataFrame([("a", "x = task.Result"), ("a", "fine"), ("b", "Thread.Sleep(1)")], "path string, line string")
    assert {(r.path, r.rule) for r in migration.rule_hits(lines, migration.SYNC_HAZARDS).collect()} == {("a", "blocking_result"), ("b", "thread_sleep")}
    vb = spark.createDataFrame([("Dim x As Object",), ("If a AndAlso b Then",)], "line string")
    assert [r.rule for r in migration.rule_hits(vb, migration.VB_TRAPS).collect()] == ["late_binding"]
    js = spark.createDataFrame([("$('#a').live('click')",)], "line string")
    assert [r.advice for r in migration.rule_hits(js, migration.JQUERY).collect()] == ["on"]
    page = spark.createDataFrame([("p", "Sub Page_Load()\nSub Page_Init()")], "path string, content string")
    assert migration.page_hooks(page).first().hooks == "init,load"
    html = spark.createDataFrame([(1, '<asp:RequiredFieldValidator id="v" ControlToValidate="Name" />')], "id int, html string")
    assert tuple(migration.validators(html, "id", "html").first()) == (1, "RequiredFieldValidator", "Name")
    diff = spark.createDataFrame([(1, "a", "+++ b/a"), (1, "a", "+x"), (1, "b", "-y"), (1, "b", "+z")], "change int, file string, line string")
    assert {(r.file, r.added, r.removed, r.kind) for r in migration.diff_stats(diff).collect()} == {("a", 1, 0, "addition"), ("b", 1, 1, "edit")}
    names = spark.createDataFrame([("Used",), ("Dead",), ("Button_Click",)], "function string")
    assert [r.function for r in migration.dead_methods(names, spark.createDataFrame([("Used",)], "target string")).collect()] == ["Dead"]
    assert spark.createDataFrame([(["a", "b", "c"], ["a", "b"])], "i array<string>, w array<string>").select(migration.covers(F.col("i"), F.col("w"))).first()[0]


def test_embedding(spark):
    a, b, c = embed.project("order page", 64), embed.project("orders page", 64), embed.project("zzz qqq", 64)
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and a @ b > a @ c and embed.project("  ", 8).tolist() == [1.0] + [0.0] * 7
    docs = spark.createDataFrame([(1, "order page"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.embedding for r in embed.embed(docs, "id", "text", 64).collect()}
    assert np.allclose(got[1], a, atol=1e-6) and got[2] == got[3]


def test_nearest_against_all(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(5)
    got = embed.nearest(vectors, "id", "v", [(7, v[7].tolist()), (9, v[9].tolist())], 5).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (7, 9):
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == np.argsort(-(u @ u[q]))[:5].tolist()

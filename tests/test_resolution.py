"""Resolution joins, configuration extractors, paging."""

from pyspark.sql import functions as F

from graphlode.operators import extract, resolve, retrieval


def test_dispatch_and_routes(spark):
    members = spark.createDataFrame([("IRepo", "Get", 1), ("Repo", "Get", 1), ("Repo", "Get", 2), ("Other", "Get", 1)], "owner string, member string, arity int")
    got = resolve.interface_dispatch(spark.createDataFrame([("Repo", "IRepo")], "klass string, interface string"), members).collect()
    assert [tuple(r) for r in got] == [("IRepo", "Repo", "Get", 1)]
    calls = spark.createDataFrame([("a.js", "https://h/Api/Orders/12?x=1"), ("b.js", "/page.aspx")], "caller string, url string")
    handlers = spark.createDataFrame([("OrdersApi", "/api/orders/{id}"), ("Page", "/Page.aspx/")], "handler string, route string")
    assert {(r.caller, r.handler) for r in resolve.resolve_routes(calls, handlers).collect()} == {("a.js", "OrdersApi"), ("b.js", "Page")}


def test_schema_imports_and_arguments(spark):
    uses = spark.createDataFrame([(1, "[dbo].[Orders]"), (2, "users"), (3, "none")], "site int, table string")
    tables = spark.createDataFrame([("t1", "orders"), ("t2", "Users"), ("t3", "USERS")], "node string, name string")
    assert {(r.site, r.node, r.status) for r in resolve.link_schema(uses, tables).collect()} == {(1, "t1", "linked"), (2, None, "ambiguous"), (3, None, "unknown")}
    imports = spark.createDataFrame([("f", "pkg", "A"), ("f", "pkg", "B"), ("f", "pkg", "C")], "file string, module string, name string")
    exports = spark.createDataFrame([("pkg", "A", "nA", None), ("pkg", "B", None, "pkg.inner"), ("pkg.inner", "B", "nB", None), ("pkg", "C", None, "pkg")], "module string, name string, node string, from_module string")
    assert {(r.name, r.node) for r in resolve.resolve_imports(imports, exports).collect()} == {("A", "nA"), ("B", "nB")}
    calls = spark.createDataFrame([(1, "f", [(None, "x"), ("c", "z")])], "call int, callee string, arguments array<struct<name:string,value:string>>")
    params = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c")], "callee string, position int, parameter string")
    assert {(r.parameter, r.value) for r in resolve.bind_arguments(calls, params).collect()} == {("a", "x"), ("c", "z")}


def test_overlay_and_prefix(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "path string, mtime int, text string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 1, "same"), ("c", 1, "new")], "path string, mtime int, text string")
    assert {(r.path, r.text) for r in resolve.overlay(old, new, "path", "mtime").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    rows = spark.createDataFrame([(1, "src/app/a"), (1, "src/app/b"), (2, "x"), (3, "a"), (3, "b")], "g int, p string")
    assert {r.g: (r.prefix, r.n) for r in resolve.common_prefix(rows, "g", "p").collect()} == {1: ("src/app/", 2), 2: ("x", 1), 3: ("", 2)}


def test_slices_and_configuration(spark):
    f = lambda content: spark.createDataFrame([("p", content)], "path string, content string")
    got = extract.logical_slice(f('a\nb\nSession("x") = 1\nc\nd\n'), ["state"]).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(2, "b"), (3, 'Session("x") = 1'), (4, "c")]
    config = '<configuration><appSettings><add key="A" value="1"/></appSettings><connectionStrings><add name="db" connectionString="x"/></connectionStrings></configuration>'
    assert {(r.kind, r.name, r.value) for r in extract.settings(f(config)).collect()} == {("setting", "A", "1"), ("connection", "db", "x")}
    rules = '<location path="admin"><system.web><authorization><allow roles="Admin"/><deny users="*"/></authorization></system.web></location>'
    r = extract.access_rules(f(rules)).first()
    assert (r.location, r.allow, r.deny) == ("admin", ["Admin"], ["*"])
    assert {(r.bundle, r.asset) for r in extract.bundles(f('bundles.Add(new ScriptBundle("~/b/js").Include("~/a.js", "~/c.js"));')).collect()} == {("~/b/js", "~/a.js"), ("~/b/js", "~/c.js")}
    report = '<DataSet Name="D"><Query><CommandText>SELECT 1</CommandText></Query><Fields><Field Name="F1"/></Fields></DataSet>'
    assert tuple(extract.report_fields(f(report)).first()) == ("p", "D", "SELECT 1", "F1")


def test_cluster_terms_and_pages(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node int, label int")
    texts = spark.createDataFrame([(1, "the order"), (2, "the order page"), (3, "the invoice")], "id int, text string")
    got = {r.label: r.term for r in extract.cluster_terms(labels, texts, "id", "text", 1).collect()}
    assert got == {0: "order", 1: "invoice"}
    rows = spark.createDataFrame([(i, "x" * 4) for i in range(5)], "id int, text string")
    page = retrieval.byte_page(rows, ["id"], "text", 10).collect()
    assert [r.id for r in page] == [0, 1] and page[-1].next_start == 2
    assert [r.id for r in retrieval.byte_page(rows, ["id"], "text", 1, start=3).collect()] == [3]
    assert spark.createDataFrame([(["a", "b", "c"],)], ["t"]).select(retrieval.ngrams(F.col("t"), 2)).first()[0] == ["a b", "b c"]

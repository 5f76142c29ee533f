"""Table functions from text to rows: markup, code, SQL, logs, chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from graphlode.functions import text as tx


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def named(text: Column, kind: str, pattern: str) -> Column:
    """Every match's first group as (``kind``, ``name``)."""
    return F.transform(all_of(text, pattern, 1), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("name")))


def inventory(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Counts of links, scripts, forms, inputs, images and headings, and the title."""
    h = F.col(html)
    n = lambda p: F.size(all_of(h, p)).cast("long")
    return pages.select(
        key,
        F.regexp_extract(h, r"(?i)<title>([^<]*)</title>", 1).alias("title"),
        n(r"(?i)<a\s[^>]*href=").alias("links"),
        n(r"(?i)<script[\s>]").alias("scripts"),
        n(r"(?i)<form[\s>]").alias("forms"),
        n(r"(?i)<input[\s>]").alias("inputs"),
        n(r"(?i)<img[\s>]").alias("images"),
        n(r"(?i)<h[1-6][\s>]").alias("headings"),
    )


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(all_of(F.col(html), r'(?i)<a\s[^>]*href="([^"]*)"', 1)).alias("href"))


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(F.transform(all_of(F.col(html), r"<([A-Za-z][A-Za-z0-9]*)[\s>]", 1), F.lower)).alias("tag")).groupBy(key, "tag").agg(F.count("*").alias("n"))


def css_classes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every class of every class attribute."""
    return pages.select(key, F.explode(all_of(F.col(html), r'(?i)\sclass="([^"]*)"', 1)).alias("attr")).select(key, F.explode(F.split(F.trim("attr"), r"\s+")).alias("css")).filter("css != ''")


def class_families(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Pages that use one set of classes."""
    sets = css_classes(pages, key, html).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("css")), " ").alias("family"))
    return sets.groupBy("family").agg(F.count("*").alias("pages"), F.min(key).alias("first_page"))


def route(url: Column) -> dict[str, Column]:
    """Parts of a URL; numbers in the path become a placeholder, so routes group."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return {
        "host": F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1),
        "path": path,
        "route": F.regexp_replace(path, r"/[0-9]+", "/{n}"),
        "query": F.regexp_extract(url, r"\?([^#]*)", 1),
    }


def visible_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"\s+", " "))


#: Language, kind and pattern of declarations; group 1 is the name (fixed values).
DECLARATIONS = {
    "python": [("function", r"(?m)^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"(?m)^\s*class\s+(\w+)")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("class", r"\b(?:struct|enum|trait)\s+(\w+)")],
    "go": [("function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"(?m)^type\s+(\w+)\s+(?:struct|interface)")],
    "java": [("class", r"\b(?:class|interface|enum)\s+(\w+)"), ("function", r"(?:public|private|protected)[\w<>\[\], ]*\s(\w+)\s*\(")],
    "csharp": [("class", r"\b(?:class|interface|struct|enum)\s+(\w+)"), ("function", r"(?:public|private|protected|internal)[\w<>\[\], ]*\s(\w+)\s*\(")],
    "vbnet": [("class", r"(?i)\b(?:class|module|interface|structure)\s+(\w+)"), ("function", r"(?i)\b(?:sub|function)\s+(\w+)")],
    "javascript": [("function", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)")],
    "typescript": [("function", r"\bfunction\s+(\w+)"), ("class", r"\b(?:class|interface)\s+(\w+)")],
    "c": [("function", r"(?m)^[A-Za-z_][\w\s\*]*\s\*?(\w+)\s*\([^;{]*\)\s*\{"), ("class", r"\bstruct\s+(\w+)\s*\{")],
    "cpp": [("function", r"(?m)^[A-Za-z_][\w\s\*:<>&]*\s[\*&]?(\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{"), ("class", r"\b(?:class|struct)\s+(\w+)")],
    "sql": [("table", r"(?i)\bcreate\s+table\s+\[?(?:\w+\]?\.\[?)?(\w+)"), ("procedure", r"(?i)\bcreate\s+(?:or\s+alter\s+)?proc(?:edure)?\s+\[?(?:\w+\]?\.\[?)?(\w+)"), ("trigger", r"(?i)\bcreate\s+trigger\s+\[?(?:\w+\]?\.\[?)?(\w+)"), ("view", r"(?i)\bcreate\s+view\s+\[?(?:\w+\]?\.\[?)?(\w+)")],
}
#: Imports; group 1 is the target (fixed values).
IMPORTS = {
    "python": r"(?m)^\s*(?:from|import)\s+([\w\.]+)",
    "rust": r"(?m)^\s*use\s+([\w:]+)",
    "go": r'(?m)^\s*(?:import\s+)?"([^"]+)"',
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w\.]+)",
    "csharp": r"(?m)^\s*using\s+([\w\.]+)\s*;",
    "vbnet": r"(?im)^\s*imports\s+([\w\.]+)",
    "javascript": r"""(?:from|require\()\s*['"]([^'"]+)['"]""",
    "typescript": r"""(?:from|require\()\s*['"]([^'"]+)['"]""",
    "c": r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]',
    "cpp": r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]',
}
#: Lines that deserve a look, by language: rule and pattern (fixed values).
DIAGNOSTICS = {
    "c": [("unbounded_copy", r"\b(?:strcpy|strcat|sprintf|gets)\s*\("), ("raw_allocation", r"\bmalloc\s*\(")],
    "cpp": [("raw_new", r"\bnew\s+\w+"), ("raw_delete", r"\bdelete\b(?:\[\])?\s+\w+"), ("c_cast", r"\(\s*(?:int|char|float|double)\s*\*?\s*\)\s*\w+")],
    "csharp": [("async_void", r"\basync\s+void\b"), ("blocking_wait", r"\.(?:Result|Wait\(\))"), ("undisposed", r"=\s*new\s+(?:SqlConnection|FileStream|StreamReader)\b")],
    "rust": [("unwrap", r"\.unwrap\(\)"), ("unsafe_block", r"\bunsafe\s*\{"), ("blocking_sleep", r"\bthread::sleep\b")],
    "vbnet": [("on_error_resume", r"(?i)\bon\s+error\s+resume\s+next\b"), ("late_binding", r"(?i)\bas\s+object\b"), ("goto", r"(?i)\bgoto\s+\w+")],
    "python": [("bare_except", r"^\s*except\s*:"), ("eval", r"\beval\s*\(")],
    "javascript": [("eval", r"\beval\s*\("), ("loose_equality", r"[^=!]==[^=]"), ("inner_html", r"\.innerHTML\s*=")],
}
STATE = r"""(?i)\b(session|viewstate|application|cache)\s*[\(\[]\s*"([^"]+)"\s*[\)\]](\s*=[^=])?"""
COOKIE = r"""(?i)\b(request|response)\s*\.\s*cookies\s*[\(\[]\s*"([^"]+)"\s*[\)\]]"""


def declarations(files: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``name`` from files (``path``, ``language``, ``content``): one scan, each file by its language's rules only."""
    found = F.lit(None).cast("array<struct<kind:string,name:string>>")
    for language, rules in DECLARATIONS.items():
        own = F.concat(*(named(F.col("content"), k, p) for k, p in rules))
        found = F.when(F.col("language") == language, own).otherwise(found)
    return files.select("path", F.inline(found))


def imports(files: DataFrame) -> DataFrame:
    pattern = F.element_at(F.create_map(*(F.lit(x) for pair in IMPORTS.items() for x in pair)), F.col("language"))
    return files.withColumn("pattern", pattern).filter("pattern IS NOT NULL").select("path", F.explode(F.expr("regexp_extract_all(content, pattern, 1)")).alias("target")).distinct()


def diagnostics(files: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``rule``: each line is tested by its language's rules only."""
    rows = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    found = F.lit(None).cast("array<string>")
    for language, rules in DIAGNOSTICS.items():
        hits = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules)), lambda x: x.isNotNull())
        found = F.when(F.col("language") == language, hits).otherwise(found)
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line_no"), F.explode(found).alias("rule"))


def state_accesses(files: DataFrame) -> DataFrame:
    """``path``, ``store``, ``state``, ``access`` (read or write); a request's cookies are read, a response's are written."""
    hits = F.transform(all_of(F.col("content"), STATE, 0), lambda m: F.struct(F.lower(F.regexp_extract(m, STATE, 1)).alias("store"), F.regexp_extract(m, STATE, 2).alias("state"), F.when(F.regexp_extract(m, STATE, 3) != "", "write").otherwise("read").alias("access")))
    cookies = F.transform(all_of(F.col("content"), COOKIE, 0), lambda m: F.struct(F.lit("cookie").alias("store"), F.regexp_extract(m, COOKIE, 2).alias("state"), F.when(F.lower(F.regexp_extract(m, COOKIE, 1)) == "response", "write").otherwise("read").alias("access")))
    return files.select("path", F.inline(F.concat(hits, cookies))).distinct()


def sql_tables(statements: DataFrame, key: str, sql: str) -> DataFrame:
    """Tables that statements read and write."""
    s = F.col(sql)
    reads = all_of(s, r"(?i)\b(?:from|join)\s+\[?(?:\w+\]?\.\[?)?(\w+)", 1)
    writes = all_of(s, r"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+\[?(?:\w+\]?\.\[?)?(\w+)", 1)
    each = F.concat(F.transform(reads, lambda t: F.struct(F.lower(t).alias("table"), F.lit("read").alias("access"))), F.transform(writes, lambda t: F.struct(F.lower(t).alias("table"), F.lit("write").alias("access"))))
    return statements.select(key, F.inline(each)).distinct()


@udtf(returnType="table_name string, column_name string, column_type string, nullable boolean, is_key boolean")
class ParseDdl:
    """Columns of the CREATE TABLE statements of a script."""

    def eval(self, script: str):
        for m in re.finditer(r"(?is)\bcreate\s+table\s+([\[\]\w\.]+)\s*\(", script or ""):
            table, depth, at = m[1].replace("[", "").replace("]", "").split(".")[-1], 1, m.end()
            start, parts = at, []
            while at < len(script) and depth:
                c = script[at]
                depth += (c == "(") - (c == ")")
                if (c == "," and depth == 1) or depth == 0:
                    parts.append(script[start:at].strip())
                    start = at + 1
                at += 1
            keys = {k.strip(" []").lower() for p in parts if (x := re.match(r"(?is)(?:constraint\s+\S+\s+)?primary\s+key[^(]*\(([^)]*)\)", p)) for k in x[1].split(",")}
            for p in parts:
                c = re.match(r"(?is)\[?(\w+)\]?\s+\[?(\w+)\]?(\s*\([^)]*\))?(.*)", p)
                if not c or c[1].lower() in ("constraint", "primary", "foreign", "unique", "check", "key", "index"):
                    continue
                rest = c[4].lower()
                key = "primary key" in rest or c[1].lower() in keys
                yield table, c[1], (c[2] + (c[3] or "").replace(" ", "")).lower(), not (key or "not null" in rest), key


@udtf(returnType="chunk_no int, start_line int, end_line int, content string")
class Chunk:
    """Line chunks of bounded size with an overlap: greedy, so it runs over each text in order."""

    def eval(self, text: str, most_chars: int, overlap: int):
        lines = (text or "").split("\n")
        start, no = 0, 0
        while start < len(lines):
            end, size = start, 0
            while end < len(lines) and (end == start or size + len(lines[end]) + 1 <= most_chars):
                size += len(lines[end]) + 1
                end += 1
            yield no, start + 1, end, "\n".join(lines[start:end])
            if end >= len(lines):
                break
            start, no = max(start + 1, end - overlap), no + 1


def chunks(docs: DataFrame, key: str, text: str, most_chars: int = 2000, overlap: int = 5) -> DataFrame:
    return docs.lateralJoin(Chunk(F.col(text).outer(), F.lit(most_chars), F.lit(overlap))).select(key, "chunk_no", "start_line", "end_line", "content")


def log_rows(lines: DataFrame, line: str) -> DataFrame:
    """``key=value`` log lines as maps, with the usual fields in columns."""
    pairs = F.map_from_entries(F.transform(all_of(F.col(line), r"(\w+)=(\"[^\"]*\"|\S+)", 0), lambda m: F.struct(F.regexp_extract(m, r"^(\w+)=", 1).alias("key"), F.regexp_replace(F.regexp_extract(m, r"=(.*)$", 1), '^"|"$', "").alias("value"))))
    rows = lines.withColumn("fields", pairs)
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return rows.select(get("event_id").alias("event_id"), get("source").alias("source"), get("target").alias("target"), F.try_to_timestamp(get("ts")).alias("ts"), "fields")


def style_profile(files: DataFrame, by: str) -> DataFrame:
    """Dominant indentation and its share per group of files (``content``)."""
    tabs, blanks = tx.occurrences(F.col("content"), r"(?m)^\t"), tx.occurrences(F.col("content"), r"(?m)^ {2,}")
    kind = F.when(tabs > blanks, "tabs").when(blanks > 0, "spaces").otherwise("none")
    count = files.select(by, kind.alias("indent")).groupBy(by, "indent").agg(F.count("*").alias("n"))
    return count.groupBy(by).agg(F.max_by("indent", F.struct("n", "indent")).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"))


#: Kinds of lines of a page's code and how they look (fixed values).
SLICES = {
    "event": r"(?i)\bhandles\s+\w+\.\w+|\bsub\s+\w+_\w+|\bon(?:click|change|load)\b",
    "ui": r"(?i)<asp:|\.(?:text|visible|enabled)\s*=",
    "data": r"(?i)\b(?:datasource|databind|dataset|datatable|gridview)\b",
    "sql": r"(?i)\b(?:select\s.+\sfrom|insert\s+into|update\s+\w+\s+set|delete\s+from|exec(?:ute)?\s+\w+)\b",
    "state": r"(?i)\b(?:session|viewstate|application|cache)\s*[\(\[]",
}


def logical_slice(files: DataFrame, kinds: list[str], around: int = 1) -> DataFrame:
    """Lines of some kinds with the lines around them: ``path``, ``line_no``, ``line``."""
    pattern = "|".join(f"(?:{SLICES[k]})" for k in kinds)
    rows = files.select("path", F.split("content", "\n").alias("all")).withColumn("hits", F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", i.cast("int")).rlike(pattern)))
    near = rows.select("path", "all", F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(F.greatest(i - around, F.lit(1)), F.least(i + around, F.size("all"))))))).alias("line_no"))
    return near.select("path", F.col("line_no").cast("long").alias("line_no"), F.element_at("all", F.col("line_no").cast("int")).alias("line"))


def settings(files: DataFrame) -> DataFrame:
    """Application settings and connection strings of configuration files (``path``, ``content``)."""
    x = lambda p: F.xpath("content", F.lit(p))
    each = F.concat(
        F.transform(F.arrays_zip(x("//appSettings/add/@key").alias("k"), x("//appSettings/add/@value").alias("v")), lambda s: F.struct(F.lit("setting").alias("kind"), s["k"].alias("name"), s["v"].alias("value"))),
        F.transform(F.arrays_zip(x("//connectionStrings/add/@name").alias("k"), x("//connectionStrings/add/@connectionString").alias("v")), lambda s: F.struct(F.lit("connection").alias("kind"), s["k"].alias("name"), s["v"].alias("value"))),
    )
    return files.select("path", F.inline(each))


def access_rules(files: DataFrame) -> DataFrame:
    """Who may and may not reach the locations of a configuration file."""
    location = F.explode(F.regexp_extract_all("content", F.lit(r'(?is)<location\s+path="[^"]*".*?</location>'), F.lit(0)))
    rows = files.select("path", location.alias("block"))
    return rows.select("path", F.regexp_extract("block", r'(?i)path="([^"]*)"', 1).alias("location"), F.regexp_extract_all("block", F.lit(r'(?i)<allow\s+\w+="([^"]*)"'), F.lit(1)).alias("allow"), F.regexp_extract_all("block", F.lit(r'(?i)<deny\s+\w+="([^"]*)"'), F.lit(1)).alias("deny"))


def bundles(files: DataFrame) -> DataFrame:
    """Asset bundles and what they include."""
    m = F.explode(F.regexp_extract_all("content", F.lit(r'(?s)new\s+(?:Script|Style)Bundle\(\s*"[^"]+"\s*\)\s*\.Include\((?:[^)]*)\)'), F.lit(0)))
    rows = files.select("path", m.alias("m"))
    return rows.select("path", F.regexp_extract("m", r'Bundle\(\s*"([^"]+)"', 1).alias("bundle"), F.explode(F.filter(F.regexp_extract_all("m", F.lit(r'"(~[^"]+)"'), F.lit(1)), lambda x: x != F.regexp_extract("m", r'Bundle\(\s*"([^"]+)"', 1))).alias("asset"))


def report_fields(files: DataFrame) -> DataFrame:
    """Data sets and fields of report definitions."""
    name = F.explode(F.regexp_extract_all("content", F.lit(r'(?s)<DataSet\s+Name="[^"]+".*?</DataSet>'), F.lit(0)))
    rows = files.select("path", name.alias("m"))
    return rows.select("path", F.regexp_extract("m", r'<DataSet\s+Name="([^"]+)"', 1).alias("data_set"), F.trim(F.regexp_extract("m", r"(?s)<CommandText>(.*?)</CommandText>", 1)).alias("sql"), F.explode_outer(F.regexp_extract_all("m", F.lit(r'<Field\s+Name="([^"]+)"'), F.lit(1))).alias("field"))


def cluster_terms(labels: DataFrame, texts: DataFrame, node: str, text: str, k: int) -> DataFrame:
    """The terms that set each cluster apart: frequency inside times inverse frequency over clusters."""
    from pyspark.sql.window import Window

    terms = labels.join(texts.select(F.col(node).alias("node"), F.explode(F.array_distinct(tx.words(F.col(text)))).alias("term")), "node").groupBy("label", "term").agg(F.count("*").alias("n"))
    spread = terms.groupBy("term").agg(F.count("*").alias("clusters"))
    total = labels.agg(F.count_distinct("label").alias("total"))
    scored = terms.join(spread, "term").crossJoin(F.broadcast(total)).withColumn("score", F.col("n") * F.log(1 + F.col("total") / F.col("clusters")))  # total: one row
    w = Window.partitionBy("label").orderBy(F.desc("score"), "term")
    return scored.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k).select("label", "term", "n", "score")

"""Flows of values and state through code, and what stands beside a method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.functions import text as tx
from graphlode.operators.resolve import innermost_at
from graphlode.lineage import cut

#: Names that a language defines itself (fixed values): calls to them are no references.
BUILTINS = (
    "isnothing", "isnumeric", "isdate", "isdbnull", "isarray", "iserror", "ctype", "directcast", "trycast", "gettype", "typeof", "nameof",
    "cstr", "cint", "clng", "cdbl", "csng", "cdec", "cbool", "cdate", "cobj", "cchar", "cbyte", "iif",
)


def is_builtin(name: Column) -> Column:
    """Whether the last segment of a name, without its arguments, is the language's own, whatever its case."""
    bare = F.trim(F.regexp_extract(F.regexp_replace(name, r"^:+", ""), r"^[^(]*", 0))
    return F.lower(F.element_at(F.split(bare, r"\."), -1)).isin(*BUILTINS)


def value_flow(links: DataFrame, sources: DataFrame, depth: int = 6) -> DataFrame:
    """What the values of ``sources`` (``node``) reach along def-use and call links (``src``, ``dst``, ``via``).

    ``root``, ``node``, the least number of steps and the link by which it was first reached (the least of several).
    """
    arcs = cut(links.select("src", "dst", "via").distinct(), "flow-links")
    seen = cut(sources.select(F.col("node").alias("root"), "node", F.lit(0).alias("steps"), F.lit(None).cast("string").alias("via")).distinct(), "flow-seen")
    for step in range(1, depth + 1):
        front = seen.filter(F.col("steps") == step - 1).select("root", F.col("node").alias("src"))
        fresh = arcs.join(front, "src").groupBy("root", F.col("dst").alias("node")).agg(F.min("via").alias("via"))
        fresh = cut(fresh.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(step).alias("steps"), "via"), "flow-front")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def state_affinity(accesses: DataFrame, least: int = 2, most_keys: int = 40) -> DataFrame:
    """State keys used by the same methods (``method``, ``state``): pairs and the number of methods that use both.

    A method with more than ``most_keys`` keys ties nothing in particular and is left out, so pairs stay linear in methods.
    """
    held = accesses.select("method", "state").distinct()
    few = held.groupBy("method").agg(F.array_sort(F.collect_set("state")).alias("keys")).filter(F.size("keys").between(2, most_keys))
    a = few.select("keys", F.posexplode("keys").alias("at", "state_a"))
    pairs = a.select("state_a", F.explode(F.slice("keys", F.col("at") + 2, F.size("keys"))).alias("state_b"))
    return pairs.groupBy("state_a", "state_b").agg(F.count("*").alias("methods")).filter(F.col("methods") >= least)


def tests_for(methods: DataFrame, tests: DataFrame) -> DataFrame:
    """Test files (``file``, ``text``) that mention a method (``method``, ``name``) as a whole word, by equality of words."""
    said = tests.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return methods.select("method", "name").distinct().join(said, "name").select("method", "file").distinct()


def runtime_nodes(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Runtime rows (``event``, ``file``, ``function``, ``line``) to source nodes (``node``, ``file``, ``name``, ``first_line``, ``last_line``).

    By name in the file if that is one node, else by the innermost range around the line; ``how`` says which.
    """
    # Functions are counted by name first, and lines looked up once each, so no row meets all functions of its file.
    names = functions.groupBy("file", F.col("name").alias("function")).agg(F.min("node").alias("named"), F.count("*").alias("n"))
    by_name = rows.join(names, ["file", "function"]).groupBy("event").agg(F.min("named").alias("named"), F.sum("n").alias("n")).filter("n = 1").select("event", "named")
    best = innermost_at(rows, functions, "file", "line", ("first_line", "last_line"), "node", 32)
    inner = rows.join(best, ["file", "line"]).groupBy("event").agg(F.min_by("node", F.struct("size", "node")).alias("inner"))
    out = rows.select("event").distinct().join(by_name, "event", "left").join(inner, "event", "left")
    how = F.when(F.col("named").isNotNull(), "name").when(F.col("inner").isNotNull(), "line").otherwise("none")
    return out.select("event", F.coalesce("named", "inner").alias("node"), how.alias("how"))


def bind_fields(bindings: DataFrame, columns: DataFrame) -> DataFrame:
    """Bound fields (``control``, ``field``, ``source``: a table or null) to columns (``table``, ``column``).

    Within the source if there is one; else where one table alone has such a column.  Others are ``ambiguous`` or ``unknown``.
    """
    low = bindings.select("control", F.lower("field").alias("key"), F.lower("source").alias("scope"))
    known = columns.select(F.lower("column").alias("key"), F.lower("table").alias("table_key"), "table", "column").distinct()
    found = low.join(known, "key", "left").filter(F.col("scope").isNull() | F.col("table_key").isNull() | (F.col("scope") == F.col("table_key")))
    agg = found.groupBy("control", "key").agg(F.count("table").alias("n"), F.min("table").alias("table"))
    out = low.join(agg, ["control", "key"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("control", F.col("key").alias("field"), F.when(n == 1, F.col("table")).alias("table"), F.when(n == 0, "unknown").when(n == 1, "bound").otherwise("ambiguous").alias("status"))


def signature_types(parameters: DataFrame, types: DataFrame) -> DataFrame:
    """Types named in signatures (``method``, ``file``, ``type``) to their nodes (``node``, ``name``, ``file``).

    A type of the same file wins; else the only one of that name; else none.
    """
    named = parameters.select("method", "file", F.lower(tx.last_segment(F.regexp_replace("type", r"\(Of .*\)|<.*>|\[\]|\(\)|\?", ""))).alias("key")).distinct()
    known = types.select(F.lower("name").alias("key"), "node", F.col("file").alias("at"))
    # A name is settled once for each file, from counts of its types, so no method meets all types of a name.
    anywhere = known.groupBy("key").agg(F.count("node").alias("n"), F.min("node").alias("any"))
    near = known.groupBy("key", F.col("at").alias("file")).agg(F.min("node").alias("near"))
    settled = named.select("key", "file").distinct().join(anywhere, "key").join(near, ["key", "file"], "left").select("key", "file", F.coalesce("near", F.when(F.col("n") == 1, F.col("any"))).alias("node"))
    return named.join(settled, ["key", "file"], "left").select("method", F.col("key").alias("type"), "node")


def global_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (``call``, ``name``, ``arguments``: how many) to functions that every page sees (``node``, ``name``, ``least``, ``most``).

    By full name, or by its last segment, where one function alone takes so many arguments.
    """
    # A name with its number of arguments is looked up once, among counts of functions: calls never meet functions.
    dotted = F.contains("name", F.lit("."))
    keyed = calls.select("call", F.lower(F.when(dotted, F.col("name")).otherwise(tx.last_segment(F.col("name")))).alias("key"), dotted.alias("dotted"), "arguments")
    full, tail = F.lower("name"), F.lower(tx.last_segment(F.col("name")))
    known = functions.select(full.alias("key"), F.lit(True).alias("dotted"), "node", "least", "most").unionByName(functions.select(tail.alias("key"), F.lit(False).alias("dotted"), "node", "least", "most"))
    known = known.groupBy("key", "dotted", "least", "most").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    asked = keyed.select("key", "dotted", "arguments").distinct().join(known, ["key", "dotted"]).filter(F.col("arguments").between(F.col("least"), F.col("most")))
    fits = asked.groupBy("key", "dotted", "arguments").agg(F.sum("n").alias("n"), F.min("node").alias("node"))
    found = keyed.join(fits, ["key", "dotted", "arguments"])
    return found.groupBy("call").agg(F.sum("n").alias("n"), F.min("node").alias("node")).filter("n = 1").select("call", "node")


def component_members(contains: DataFrame, files: DataFrame) -> DataFrame:
    """Members of each file's components: what the file contains, and what that contains."""
    first = files.select(F.col("node").alias("file")).join(contains.toDF("file", "component"), "file")
    second = first.join(contains.toDF("component", "member"), "component").select("file", "member", F.lit(2).alias("level"))
    return first.select("file", F.col("component").alias("member"), F.lit(1).alias("level")).unionByName(second).groupBy("file", "member").agg(F.min("level").alias("level"))


#: What marks SQL put together from values, and a repository's usual forms (fixed values).
CONCATENATED = r"""(?i)(?:select|insert|update|delete)\b[^"']*["']\s*(?:&|\+)"""
PARAMETERISED = r"(?i)(?:addwithvalue|parameters\.add|@\w+)"
#: Kinds of background work, the words that tell them and what takes their place (fixed values).
BACKGROUND = {
    "windows_service": (("servicebase",), "hosted service"),
    "quartz_scheduled_job": (("ijob", "execute", "quartz"), "scheduler on the new host"),
    "hangfire_job": (("backgroundjob.enqueue|recurringjob.addorupdate",), "unchanged on the new host"),
    "timer_service": (("system.timers.timer|system.threading.timer", "servicebase|onstart"), "periodic timer in a hosted service"),
}


def sql_risk(lines: DataFrame) -> DataFrame:
    """Lines (``file``, ``line_no``, ``line``) with SQL put together from values; a file that also binds parameters is ``mixed``."""
    marks = lines.withColumn("joined", F.col("line").rlike(CONCATENATED)).withColumn("bound", F.col("line").rlike(PARAMETERISED))
    agg = marks.groupBy("file").agg(F.count_if("joined").alias("joined"), F.count_if("bound").alias("bound")).filter("joined > 0 OR bound > 0")
    return agg.select("file", "joined", "bound", F.when(F.col("joined") == 0, "parameterised").when(F.col("bound") == 0, "injectable").otherwise("mixed").alias("strategy"))


def background_services(files: DataFrame) -> DataFrame:
    """Kinds of background work in a file (``file``, ``text``): every group of words must occur, one of each will do."""
    low = F.lower("text")

    def told(words):
        any_of = F.lit(False)
        for w in words.split("|"):
            any_of = any_of | F.contains(low, F.lit(w))
        return any_of

    kinds = []
    for kind, (groups, instead) in BACKGROUND.items():
        every = F.lit(True)
        for g in groups:
            every = every & told(g)
        kinds.append(F.when(every, F.struct(F.lit(kind).alias("pattern"), F.lit(instead).alias("instead"))))
    return files.select("file", F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("file", "x.*")


def retained_evidence(evidence: DataFrame, scope: list[str], entities: list[str]) -> DataFrame:
    """Evidence (``id``, ``path``, ``text``) under one of the path prefixes, or that names one of the entities as a word."""
    path = F.replace(F.lower("path"), F.lit("\\"), F.lit("/"))
    kept = F.lit(not scope and not entities)
    for p in scope:
        kept = kept | F.startswith(path, F.lit(p.lower()))
    if entities:
        kept = kept | F.arrays_overlap(tx.words(F.col("text")), F.array(*(F.lit(e.lower()) for e in entities)))
    return evidence.filter(kept)


def rerank(hits: DataFrame, semantic: DataFrame, key: str, budget: int, weight: float = 0.5) -> DataFrame:
    """Hits (``key``, ``score``) with a second score where one of the first ``budget`` has it; ``status`` says where none was."""
    turn = F.row_number().over(Window.orderBy(F.desc("score"), key))  # over a result list, which is bounded
    rows = hits.withColumn("turn", turn).join(semantic.select(key, "semantic"), key, "left")
    status = F.when(F.col("turn") > budget, "over_budget").when(F.col("semantic").isNull(), "missing").otherwise("applied")
    rows = rows.withColumn("semantic_status", status)
    mixed = F.when(F.col("semantic_status") == "applied", (1 - weight) * F.col("score") + weight * F.col("semantic")).otherwise((1 - weight) * F.col("score"))
    return rows.select(key, mixed.alias("score"), "semantic_status")


def harvest(reverts: DataFrame, hunks: DataFrame, least: int = 1) -> DataFrame:
    """Anti-patterns from reverted changes: the words of their added text (``change``, ``text``), with how often it was reverted."""
    n = reverts.groupBy("change").agg(F.count("*").alias("reverts")).filter(F.col("reverts") >= least)
    return hunks.join(n, "change").select("change", "reverts", F.array_sort(F.array_distinct(tx.words(F.col("text")))).alias("terms"))


def api_inventory(calls: DataFrame, replacements: DataFrame) -> DataFrame:
    """Uses of a library's classes (``file``, ``api``): sites, files and what takes their place (``api``, ``replacement``)."""
    agg = calls.groupBy("api").agg(F.count("*").alias("sites"), F.count_distinct("file").alias("files"))
    return agg.join(replacements, "api", "left").select("api", "sites", "files", F.coalesce("replacement", F.lit("none known")).alias("replacement"))

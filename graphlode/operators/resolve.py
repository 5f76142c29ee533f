"""Joins that resolve names, places and sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlode.functions import text as tx


def resolve(asked: DataFrame, ask: str, named: DataFrame, node: str, rungs: Sequence[tuple[str, Column, Column, float]]) -> DataFrame:
    """Each asked name on the first rung where something matches.

    A rung is (name, expression on ``asked``, expression on ``named``, confidence): an
    equi-join each, so no rung compares all with all.  ``status`` is unique, ambiguous
    or not_found; an ambiguous name gets no node.
    """
    found = None
    for i, (rung, left, right, confidence) in enumerate(rungs):
        one = (
            asked.select(F.col(ask), left.alias("key")).filter("key IS NOT NULL").join(named.select(F.col(node).alias("node"), right.alias("key")), "key")
            .groupBy(ask).agg(F.count_distinct("node").alias("candidates"), F.min("node").alias("node"))
            .select(ask, F.lit(i).alias("step"), F.lit(rung).alias("rung"), F.lit(confidence).alias("confidence"), "candidates", "node")
        )
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy(ask).orderBy("step")
    first = found.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn", "step")
    unique = F.col("candidates") == 1
    return asked.select(ask).distinct().join(first, ask, "left").select(
        ask,
        F.when(F.col("candidates").isNull(), "not_found").when(unique, "unique").otherwise("ambiguous").alias("status"),
        F.when(unique, F.col("node")).alias("node"),
        "rung",
        F.when(unique, F.col("confidence")).alias("confidence"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def name_rungs(asked: str, ident: str, path: str, name: str, qualified: str) -> list:
    """The usual ladder: id, path, name, qualified name, last segment."""
    a = F.col(asked)
    return [
        ("id", a, F.col(ident), 1.0),
        ("path", a, F.col(path), 0.95),
        ("name", F.lower(a), F.lower(F.col(name)), 0.85),
        ("qualified", F.lower(a), F.lower(F.col(qualified)), 0.9),
        ("terminal", F.lower(tx.last_segment(a)), F.lower(tx.last_segment(F.col(qualified))), 0.45),
    ]


def overlap_join(left: DataFrame, right: DataFrame, on: str, l_range: tuple[str, str], r_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of closed ranges that overlap within ``on``.

    Ranges are dealt to buckets of ``width``; a pair is kept in the first bucket that
    both touch, so it comes out once and the join is an equi-join.
    """
    ls, le = l_range
    rs, re = r_range
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.filter(F.col(ls) <= F.col(le)).withColumn("bucket_", bucket(ls, le))
    b = right.filter(F.col(rs) <= F.col(re)).withColumn("bucket_", bucket(rs, re))
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / width)
    return a.join(b, [on, "bucket_"]).filter((F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("bucket_") == first)).drop("bucket_")


def overlap_pairs(left: DataFrame, right: DataFrame, on: str, l_range: tuple[str, str], r_range: tuple[str, str], width: int) -> DataFrame:
    """The pairs of ``overlap_join`` where ranges on the left repeat.

    Equal ranges on the left meet the right once, as a list, and are told apart after the join.  A row of
    the right then stands beside the same list again and again, which columnar files store as references.
    """
    rest = [c for c in left.columns if c not in (on, *l_range)]
    held = left.groupBy(on, *l_range).agg(F.collect_list(F.struct(*rest)).alias("held_"))
    met = overlap_join(held, right, on, l_range, r_range, width)
    others = [c for c in met.columns if c != "held_"]
    return met.select(*others, F.explode("held_").alias("one_")).select(*others, *(F.col(f"one_.{c}") for c in rest))


def innermost(pairs: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Of the ranges that hold a point, the shortest."""
    w = Window.partitionBy(key).orderBy((F.col(end) - F.col(start)), tie)
    return pairs.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def innermost_at(points: DataFrame, ranges: DataFrame, on: str, at: str, span: tuple[str, str], tie: str, width: int) -> DataFrame:
    """For each distinct point (``on``, ``at``) the shortest range around it: ``tie`` and its ``size``.

    Equal points and equal ranges meet once, so repeated hits do not multiply the pairs.
    """
    start, end = span
    asked = points.select(on, at).distinct().withColumn("upto_", F.col(at))
    held = ranges.groupBy(on, start, end).agg(F.min(tie).alias(tie))
    size = (F.col(end) - F.col(start)).alias("size")
    best = overlap_join(asked, held, on, (at, "upto_"), span, width).groupBy(on, at).agg(F.min(F.struct(size, F.col(tie))).alias("best_"))
    return best.select(on, at, f"best_.{tie}", "best_.size")


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))


def triage(frames: DataFrame, files: DataFrame, k: int = 8) -> DataFrame:
    """Stack frames (``frame_file``) to files (``path``, ``centrality``) by base name; best k."""
    hits = frames.select(base_name(F.col("frame_file")).alias("base")).groupBy("base").agg(F.count("*").alias("frames"))
    scored = files.withColumn("base", base_name(F.col("path"))).join(hits, "base")
    return scored.select("path", "frames", (0.3 * F.col("frames") + 0.1 * F.coalesce("centrality", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def reconcile(static: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Static and observed edges side by side: confirmed, unobserved or undeclared."""
    a = static.select(*keys).distinct().withColumn("is_static", F.lit(True))
    b = seen.select(*keys).distinct().withColumn("is_seen", F.lit(True))
    status = F.when(F.col("is_static") & F.col("is_seen"), "confirmed").when(F.col("is_static"), "unobserved").otherwise("undeclared")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def longest_prefix(items: DataFrame, path: str, rules: DataFrame, prefix: str) -> DataFrame:
    """The rule with the longest prefix of each path: paths are cut at slashes and joined by equality."""
    parts = F.split(F.col(path), "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    w = Window.partitionBy(path).orderBy(F.desc(F.length(prefix)))
    return items.withColumn(prefix, F.explode(heads)).join(rules, prefix).withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def changed(old: DataFrame, new: DataFrame, key: str, marks: Sequence[str]) -> DataFrame:
    """Added, removed and modified keys between two fingerprint tables."""
    a = old.select(key, F.struct(*marks).alias("old"))
    b = new.select(key, F.struct(*marks).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def interface_dispatch(implements: DataFrame, members: DataFrame) -> DataFrame:
    """Interface members (``owner``, ``member``, ``arity``) to the members of classes that implement them (``klass``, ``interface``)."""
    wanted = implements.join(members.toDF("interface", "member", "arity"), "interface")
    return wanted.join(members.toDF("klass", "member", "arity"), ["klass", "member", "arity"]).select("interface", "klass", "member", "arity")


def route_key(url: Column) -> Column:
    """A URL or handler path reduced to what both sides share: lower case, no host, query, extension or trailing slash, numbers and ``{x}`` as one."""
    out = F.regexp_replace(F.lower(url), r"^[a-z]+://[^/]*|[?#].*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"/+$", ""), r"\.(?:aspx|ashx|asmx|svc)$", "")
    return F.regexp_replace(out, r"/(?:\d+|\{[^}]*\})(?=/|$)", "/{}")


def resolve_routes(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """Client calls (``caller``, ``url``) to handlers (``handler``, ``route``)."""
    return calls.withColumn("key", route_key(F.col("url"))).join(handlers.select("handler", route_key(F.col("route")).alias("key")), "key").select("caller", "url", "handler")


def link_schema(uses: DataFrame, tables: DataFrame) -> DataFrame:
    """Table names in SQL (``site``, ``table``) to catalogue tables (``node``, ``name``); a name of several tables is ambiguous."""
    known = tables.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("node").alias("node"))
    rows = uses.withColumn("key", F.lower(tx.last_segment(F.regexp_replace("table", r"[\[\]]", "")))).join(known, "key", "left")
    return rows.select("site", "table", F.when(F.col("n") == 1, F.col("node")).alias("node"), F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "linked").otherwise("ambiguous").alias("status"))


def resolve_imports(imports: DataFrame, exports: DataFrame, depth: int = 8) -> DataFrame:
    """Imported names (``file``, ``module``, ``name``) to their definition, through re-exports.

    ``exports`` has (``module``, ``name``, ``node``, ``from_module``): a definition has a node, a re-export the module it passes on.
    """
    left = imports.select("file", "module", "name", F.col("module").alias("at"))
    found = None
    for _ in range(depth):
        step = left.join(exports.withColumnRenamed("module", "at"), ["at", "name"])
        done = step.filter("node IS NOT NULL").select("file", "module", "name", "node")
        found = done if found is None else found.unionByName(done)
        left = step.filter("node IS NULL").select("file", "module", "name", F.col("from_module").alias("at")).distinct()
        if left.isEmpty():
            break
    return found.distinct()


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Arguments of calls (``call``, ``callee``, ``arguments``: name or null, and value) to parameters (``callee``, ``position``, ``parameter``)."""
    args = calls.select("call", "callee", F.posexplode("arguments").alias("position", "argument"))
    by_name = args.filter("argument.name IS NOT NULL").select("call", "callee", F.col("argument.name").alias("parameter"), F.col("argument.value").alias("value")).join(parameters.select("callee", "parameter"), ["callee", "parameter"])
    by_place = args.filter("argument.name IS NULL").select("call", "callee", "position", F.col("argument.value").alias("value")).join(parameters, ["callee", "position"])
    return by_name.select("call", "parameter", "value").unionByName(by_place.select("call", "parameter", "value"))


def overlay(indexed: DataFrame, fresh: DataFrame, key: str, mark: str) -> DataFrame:
    """Indexed rows, with fresh rows in place of those that are stale or not there."""
    new = fresh.join(indexed.select(key, F.col(mark).alias("old_mark")), key, "left").filter(F.col("old_mark").isNull() | (F.col("old_mark") != F.col(mark))).drop("old_mark")
    return indexed.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def common_prefix(rows: DataFrame, by: str, path: str) -> DataFrame:
    """The longest common prefix of each group: that of its least and greatest member."""
    agg = rows.groupBy(by).agg(F.min(path).alias("a"), F.max(path).alias("b"), F.count("*").alias("n"))
    size = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    return agg.select(by, F.substring("a", F.lit(1), F.when(F.length("a") > 0, size).otherwise(0)).alias("prefix"), "n")

"""Steps must not multiply rows that share a key: the widest operator of a plan stays near the input."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphlode import plans
from graphlode.operators import embed, flows, graph, index, legacy, migration, resolve, review, temporal

from oracle import differences

plans.load_all()
N = 600


def folder(spark, path, **columns):
    """A folder of tables of N rows, each column an expression of ``i`` from 1."""
    for name, exprs in columns.items():
        spark.range(1, N + 1).select(*(F.expr(e.replace("{i}", "id")).alias(c) for c, e in exprs.items())).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def widest(df, of=""):
    """Rows of the operator (with ``of`` in its name) with the most of them, and the result."""
    rows = df.collect()
    stack, most = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        p = stack.pop()
        n = p.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() and of in p.nodeName() else 0)
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(p.plan())
        else:
            stack += [p.children().apply(i) for i in range(p.children().size())]
    return most, rows


def test_innermost_function_looks_a_point_up_once(spark, tmp_path):
    at = folder(spark, tmp_path, lineitem={"l_orderkey": "{i} * 50", "l_partkey": "{i} * 997", "l_linenumber": "1"}, part={"p_partkey": "{i} * 49850", "p_size": "5 + {i} % 2"})
    most, rows = widest(plans.QUERIES["innermost_function"](spark, at))
    assert most <= 4 * N and len(rows) == N and {r.symbol for r in rows} == {2 * 49850}


def test_equal_hits_meet_the_symbols_once(spark, tmp_path):
    at = folder(spark, tmp_path, lineitem={"l_orderkey": "{i} * 50", "l_partkey": "{i} * 997", "l_linenumber": "CAST(1 + {i} % 2 AS INT)"}, part={"p_partkey": "{i} * 49850", "p_size": "CAST({i} % 3 AS INT)"})
    most, rows = widest(plans.QUERIES["hit_symbol_range_join"](spark, at), "Join")
    assert most == 2 * N and len(set(rows)) == len(rows) == N * N
    more = resolve.overlap_pairs(
        spark.createDataFrame([(1, 5, 9, 7, None), (1, 5, 9, 7, "b"), (1, 9, 40, 8, "c"), (1, 9, 8, 9, "d"), (None, 5, 9, 1, "e")], "on long, s long, e long, hit long, note string"),
        spark.createDataFrame([(1, 9, 33, 1), (1, 41, 50, 2), (2, 5, 9, 3), (None, 5, 9, 4)], "on long, fs long, fe long, symbol long"), "on", ("s", "e"), ("fs", "fe"), 4,
    )
    assert {(r.s, r.hit, r.note, r.symbol) for r in more.collect()} == {(5, 7, None, 1), (5, 7, "b", 1), (9, 8, "c", 1)} and more.count() == 3


def test_runtime_rows_do_not_meet_all_functions_of_a_file(spark, tmp_path):
    at = folder(spark, tmp_path, events={"event_id": "{i} * 2000", "user_id": "{i} * 20", "event_type": "'error'"}, part={"p_partkey": "{i} * 2800", "p_size": "5"})
    most, rows = widest(plans.QUERIES["runtime_to_node"](spark, at))
    assert most <= 4 * N and {tuple(r)[1:] for r in rows} == {(2800, "line")} and len(rows) == N


def test_methods_do_not_meet_all_types_of_a_name(spark, tmp_path):
    at = folder(spark, tmp_path, lineitem={"l_orderkey": "{i}", "l_suppkey": "{i} * 10 + 1", "l_partkey": "{i} * 60"}, part={"p_partkey": "{i} * 2910"})
    most, rows = widest(plans.QUERIES["signature_types"](spark, at))
    assert most <= 4 * N and {tuple(r)[1:] for r in rows} == {("t0", None)} and len(rows) == N


def test_trails_hold_four_digits_as_the_sql_does(spark):
    arcs = spark.createDataFrame([("r", "a", 12345), ("r", "b", 7)], "src string, dst string, position long")
    out = migration.blueprint(arcs, spark.createDataFrame([("r",)], "node string"))
    assert {r.trail for r in out.collect()} == {"r", "r/1234:a", "r/0007:b"}


def test_calls_do_not_meet_all_functions_of_a_name(spark, tmp_path):
    at = folder(spark, tmp_path, orders={"o_orderkey": "{i} * 4 + 1", "o_custkey": "{i} * 80"}, supplier={"s_suppkey": "{i} * 180"})
    most, rows = widest(plans.QUERIES["global_functions"](spark, at))
    assert most <= 4 * N and not rows


def test_global_calls_by_full_name_or_last_segment(spark):
    calls = spark.createDataFrame([(1, "app.G", 1), (2, "G", 1), (3, "g", 5), (4, "x::H", 0), (5, "b.g", 3)], "call long, name string, arguments long")
    functions = spark.createDataFrame([(10, "App.g", 0, 2), (11, "b.G", 3, 9), (12, "App.h", 0, 0)], "node long, name string, least long, most long")
    assert {tuple(r) for r in flows.global_calls(calls, functions).collect()} == {(1, 10), (2, 10), (3, 11), (4, 12), (5, 11)}


def test_nearest_holds_few_scores_at_a_time(spark):
    """The best of many batches, with ties, beside a matrix of all scores; no scores of all queries at once."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (1500, 4)).astype(float)
    ids = np.arange(0, 1500, 5)
    queries, shapes = (ids, v[ids]), []
    best = [embed.Best(ids[at : at + 256], 7, 6, True) for at in (0, 256)]
    for at in range(0, 1500, 100):
        for b, lo in zip(best, (0, 256)):
            b.take(embed.unit(v[ids])[lo : lo + 256] @ embed.unit(v[at : at + 100]).T, np.arange(at, min(at + 100, 1500)))
            shapes.append(len(b.row))
    assert max(shapes) <= 256 * 7
    s = np.round(embed.unit(v[ids]) @ embed.unit(v).T, 6)
    want = {}
    for i, q in enumerate(ids):
        order = [x for x in np.lexsort((np.arange(1500), -s[i])) if x != q][:7]
        want[int(q)] = [(int(x), s[i, x]) for x in order]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in embed.nearest(vectors, "id", "v", queries, 7, 6, others=True).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert got == want
    for b in best:
        for q, k, x in zip(b.ids[b.row], b.key, b.score):
            assert (int(k), x) in want[int(q)]


def test_search_quality_takes_no_pairs_of_rows(spark, tmp_path):
    at = folder(spark, tmp_path, embeddings={"vec_id": "{i}", "label": "CAST({i} % 3 AS INT)", "embedding": "array(CAST(sin({i}) AS FLOAT), CAST(cos({i}) AS FLOAT), 0.5F)"})
    most, rows = widest(plans.QUERIES["ndcg_recall_mrr"](spark, at))
    assert most <= 4 * N and len(rows) == N // 50
    assert not differences(spark, at, plans.QUERIES["ndcg_recall_mrr"], plans.ORACLES["ndcg_recall_mrr"])[0]


def test_tasks_of_a_history_grow_with_it(spark):
    """Partitions joined to the number of cores would each hold a share of the whole history."""
    rows = spark.range(500_000).select((F.col("id") % 100_000).alias("change"), (F.col("id") % 977).alias("file"))
    held = temporal.change_files(rows, "change", "file")
    assert held.rdd.getNumPartitions() > 4 and temporal.cochanges(held).rdd.getNumPartitions() > 4
    assert graph.oriented(rows.toDF("src", "dst"), "both").rdd.getNumPartitions() > 4


def waves_one_by_one(nodes, edges):
    arcs, left, out, wave = {(a, b) for a, b in edges if a != b and a in nodes and b in nodes}, set(nodes), {}, 0
    while left:
        need = {x: sum(a == x for a, _ in arcs) for x in left}
        ready = [x for x in left if not need[x]] or [min(left, key=lambda x: (need[x], x))]
        out |= dict.fromkeys(ready, wave)
        left -= set(ready)
        arcs = {(a, b) for a, b in arcs if a in left and b in left}
        wave += 1
    return out


def test_released_cycles_cost_no_round_each(spark):
    rng = np.random.default_rng(8)
    numbers = [(int(a), int(b)) for a, b in rng.integers(0, 60, (130, 2))] + [(x, x + 1) for x in range(100, 130)]
    for edges in (numbers, [(f"n{a}", f"n{b}") for a, b in numbers]):
        df = spark.createDataFrame(edges, ["src", "dst"])
        spark.sparkContext.setJobGroup("waves", "")
        got = {r.node: r.wave for r in graph.waves(graph.nodes_of(df), df, together=9).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("waves"))
        spark.sparkContext.setJobGroup("other", "")
        assert got == waves_one_by_one({x for e in edges for x in e}, edges) and jobs < 400
        assert len(set(got.values())) > 20


def between_one_by_one(edges, picked, most_depth):
    arcs = {(a, b) for a, b in edges if a != b}
    nodes = {x for e in edges for x in e}
    score = dict.fromkeys(nodes, 0.0)
    for p in picked:
        levels, paths, seen = [[p]], {p: 1.0}, {p}
        while levels[-1] and len(levels) <= most_depth:
            fresh = {b for a, b in arcs if a in levels[-1]} - seen
            for b in fresh:
                paths[b] = sum(paths[a] for a in levels[-1] if (a, b) in arcs)
            seen |= fresh
            levels.append(sorted(fresh))
        credit = dict.fromkeys(seen, 0.0)
        for near, far in list(zip(levels, levels[1:]))[::-1]:
            for a in near:
                credit[a] = sum(paths[a] / paths[b] * (1 + credit[b]) for b in far if (a, b) in arcs)
        for x in seen - {p}:
            score[x] += credit[x] * len(nodes) / len(picked)
    return score


def test_levels_of_pivots_cost_no_job_each(spark):
    rng = np.random.default_rng(6)
    numbers = [(int(a), int(b)) for a, b in rng.integers(0, 50, (90, 2))] + [(x, x + 1) for x in range(40, 60)] + [(90, 90)]
    for edges in (numbers, [(f"n{a}", f"n{b}") for a, b in numbers]):
        df, nodes = spark.createDataFrame(edges, ["src", "dst"]), sorted({x for e in edges for x in e})
        picked = [nodes[i * len(nodes) // 4] for i in range(4)]
        for depth, most_arcs in ((64, 1000), (5, 1000), (5, 0)):
            group = f"pivots {edges[0]} {depth} {most_arcs}"
            spark.sparkContext.setJobGroup(group, "")
            got = {r.node: r.score for r in graph.betweenness(df, 4, depth, most_arcs).collect()}
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
            spark.sparkContext.setJobGroup("other", "")
            want = between_one_by_one(edges, picked, depth)
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and any(want.values())
            assert jobs < 40 or not most_arcs


def ranks_one_by_one(edges, rounds=20):
    nodes, out = {x for e in edges for x in e}, {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    out.pop(None, None)  # as in SQL, what equals nothing is a sink and gets nothing
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        got, lost = dict.fromkeys(nodes, 0.0), sum(r for x, r in rank.items() if x not in out)
        for a, b in edges:
            if a is not None and b is not None:
                got[b] += rank[a] / out[a]
        rank = {x: 0.15 / n + 0.85 * (g + lost / n) for x, g in got.items()}
    return rank


def test_a_round_of_ranks_takes_fewer_rows_than_arcs(spark):
    edges = [(a, 1000 + b) for a in range(30) for b in range(400)]
    most, rows = widest(graph.pagerank(spark.createDataFrame(edges, ["src", "dst"]), rounds=2, together=1000))
    want = ranks_one_by_one(edges, 2)
    assert most < len(edges) / 4 and len(rows) == 430 and all(abs(r.rank - want[r.node]) < 1e-12 for r in rows)


def test_ranks_of_hubs_parallel_arcs_and_nulls(spark):
    rng = np.random.default_rng(5)
    numbers = [(int(a), int(b)) for a, b in rng.integers(0, 80, (300, 2))] * 2 + [(x, 7) for x in range(200)] + [(3, x) for x in range(300)]
    texts = [(f"n{a}", f"ñ{b}" if b % 2 else f"n{b}") for a, b in numbers] + [(None, "n1"), ("n2", None), ("n2", None)]
    for edges in (numbers, texts):
        df, want = spark.createDataFrame(edges, ["src", "dst"]), ranks_one_by_one(edges, 7)
        for together in (20, 2_000_000):  # 20: targets with more arcs than a block
            got = {r.node: r.rank for r in graph.pagerank(df, rounds=7, together=together).collect()}
            assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert not spark.catalog.listTables() and not graph.pagerank(df.limit(0)).count()


def test_trigrams_are_hashed_once():
    """A repeated text costs no further hashes, and slots are those of the plain count."""
    text = "Åström 😀 said: the thing, the THING. " * 50
    embed.slot_of.cache_clear()
    v = embed.project(text, 64)
    assert embed.slot_of.cache_info().misses < 60
    want, t = np.zeros(64), f" {text.strip().lower()} "
    for i in range(len(t) - 2):
        g = t[i : i + 3].encode()
        want[xxhash.xxh3_64_intdigest(g) % 64] += 1.0 if xxhash.xxh3_64_intdigest(g, seed=1) & 1 else -1.0
    assert (v == want / np.linalg.norm(want)).all()


def test_lines_are_shuffled_once_for_anti_patterns(spark):
    lines = spark.range(1000).select(F.lit(1).alias("change"), (F.col("id") % 50).alias("file"), F.lit("alpha beta gamma delta").alias("line"))
    patterns = spark.createDataFrame([(7, ["alpha", "beta", "gamma", "delta", "other"])], "pattern long, terms array<string>")
    out = review.anti_patterns(lines, patterns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and out.count() == 50


def test_pages_of_one_file_go_to_many_tasks(spark):
    files = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.lit("L.map(x); <% Session(\"a\") = 1 %>").alias("content"))
    for out in (legacy.map_parts(files), legacy.classic(files)):
        assert out.rdd.getNumPartitions() >= 4 and out.count() == 40
    assert "Exchange" not in legacy.map_parts(files)._jdf.queryExecution().executedPlan().toString().split("Generate")[0]


def test_postings_are_counted_without_a_shuffle_of_their_own(spark):
    docs = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("word word x"), F.col("id")).alias("t"))
    rows = index.postings(docs, "k", "t")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan.split("Generate")[0]
    assert {(r.tf, r.len) for r in rows.filter("term = 'word'").collect()} == {(2, 3)} and rows.count() == 400

"""The repeats' fence follows the group, and can reject what the base rule lets pass."""

import numpy as np

from graphlode.llm import qualityrules

SCHEMA = "doc_id long, text string, lang string, source string"


def own(key, n):
    return [f"w{key}x{i}" for i in range(n)]


def repeating(key, n, share):
    """A text of about n words, of which a share stands in a passage said twice."""
    half = own(f"{key}r", int(n * share / 2))
    return " ".join(half + own(key, n - 2 * len(half)) + half)


def test_repeats_beyond_the_group_are_rejected(spark):
    clean = [(i, " ".join(own(i, 200)), "en", "clean") for i in range(40)]
    line = " ".join(own("line", 13))
    odd = [
        (100, repeating(100, 1000, 0.45), "en", "clean"),
        (101, repeating(101, 1000, 0.10), "en", "clean"),
        (102, f"{line}\n{' '.join(own(102, 40))}\n{line}", "en", "clean"),
    ]
    refrains = [(200 + i, repeating(200 + i, 1000, 0.35 + 0.01 * (i % 12)), "en", "songs") for i in range(36)]
    docs = spark.createDataFrame(clean + odd + refrains, SCHEMA).repartition(4)
    found = {r.k: r for r in qualityrules.quality_rules(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert not found[100].kept  # 45 % in a source whose median and spread are nought
    assert found[101].kept and found[102].kept
    assert all(found[i].kept for i in range(40)) and all(found[200 + i].kept for i in range(36))
    assert {r.doc_id for r in qualityrules.keep_good(docs).collect()} == {k for k, r in found.items() if r.kept}


def test_each_rule_rejects_something(spark):
    prose = lambda key, n=200: " ".join(own(key, n))
    rows = [(i, prose(200 + i), "en", "plain") for i in range(40)]
    once = "\n".join(f"{prose(500 + i, 8)}" for i in range(30))
    rows += [
        (100, prose(100) + " #" * 30, "en", "plain"),
        (101, repeating(101, 1000, 0.4), "en", "plain"),
        (102, once + "\nover again" * 12, "en", "plain"),
        (103, " ".join(f"w{i}" + "x" * 20 for i in range(200)), "en", "plain"),
        (104, " ".join(f"w104x{i}" for i in np.random.default_rng(0).integers(10, 50, 300)), "en", "plain"),
        (105, prose(105) + " # $", "en", "plain"),
        (106, prose(106), "xx", "rare"),
        (107, prose(107) + " #" * 30, "xx", "rare"),
    ]
    found = {r.k: r for r in qualityrules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in range(100, 108) if not found[k].kept] == [100, 101, 102, 103, 104, 107]
    assert all(found[i].kept for i in range(40))
    beyond = lambda k, m: not found[k][f"{m}_low"] <= found[k][m] <= found[k][f"{m}_high"]
    for k, m in ((100, "symbol_rate"), (101, "repeat_rate"), (102, "dup_line_rate"), (103, "mean_word"), (104, "distinct_rate"), (107, "symbol_rate")):
        assert not found[k].base_failed and beyond(k, m), (k, m)


def test_a_base_failing_text_does_not_move_the_fences(spark):
    rows = [(i, " ".join(own(i, 200)), "en", "s") for i in range(40)]
    junk = [(100 + i, "# " * 300, "en", "s") for i in range(200)]
    limits = [sorted(map(tuple, qualityrules.fences(qualityrules.sketches(qualityrules.measure(spark.createDataFrame(x, SCHEMA)))).collect())) for x in (rows, rows + junk)]
    assert limits[0] == limits[1]

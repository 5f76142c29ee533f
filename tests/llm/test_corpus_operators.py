"""Every operator against its plain version, on rows with all the awkward cases."""

import math
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from graphlode.llm import components, decontaminate, hmm, licenses, linededup, mil, minhash, packing, qualityrules, queries, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept boolean, k string, body string, score double"
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short one here"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta"), (10, "Ünder the Sea, there are eight words or more"), (6, "solo")]


def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(2, 6))))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = "This line is shared by MANY documents and is long enough"
    base = prose(120).split()
    rows = []
    for i in range(12):
        own = list(base)
        for j in rng.integers(0, len(own), i // 2):
            own[j] = word()
        rows.append((i, " ".join(own)))
    rows += [(20 + i, f"{prose(60)}\n  {shared.upper() if i % 2 else shared} \t\n{prose(8)}\n{shared}") for i in range(7)]
    rows += [
        (40, None), (41, ""), (42, " \n\t\n "), (43, "one"), (44, "one two three"), (45, "One TWO three"), (46, "x " * 3000), (47, "\n".join(["same line here again"] * 60)),
        (48, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0, under the MIT license"), (49, "CC BY-NC 4.0 and cc by nc; under the mit"), (50, "permission is hereby granted"),
        (51, ITEMS[0][1] + " " + prose(30)), (52, "Alpha, beta gamma delta epsilon zeta eta theta -- short ONE here solo"), (53, "ünder the sea there are eight words or more solo"), (54, "### $$$ %% a*b <c> | & " * 30),
        (55, "é" * 45), (56, "naïve café " * 40), (57, "漢字 かな <|endoftext|> emoji 😀 \u0085   x"), (58, "tab\tand\x0bvertical\x0cform\rreturn\x00nul\x1f"), (59, prose(20_000)), (None, "a row without a key " * 20), (60, rows[0][1]), (60, rows[0][1]),
        (61, f"{shared}"), (62, "\n\n\n"), (-5, prose(70)), (1 << 40, prose(70)),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, ["en", "fr", None][i % 3], ["s0", None][i % 2], 1, True, "clash", "clash", 0.5) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


def test_licenses(docs, rows):
    got = sorted(((r.k, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()), key=repr)
    want = sorted(((licenses_key(k), *brute.licenses(t)) for k, t in rows), key=repr)
    assert got == want
    by = {r.k: r for r in licenses.scan_licenses(docs).collect()}
    assert by[48].labels == "apache-2,mit" and by[48].score == 1.0
    assert by[40].labels == "" and by[40].score == 0.0
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in by.values())


def licenses_key(k):
    return -(1 << 63) if k is None else k


def test_license_templates(spark):
    name = dict((label, t) for label, t, _ in licenses.TEMPLATES)
    docs = spark.createDataFrame([(1, "so: " + name["bsd"].upper() + " etc"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "redistribution of source")], "doc_id long, text string")
    got = {r.k: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "bsd", 2: "gpl-3", 3: ""}


def test_quality_measures(docs, rows):
    found = qualityrules.quality_rules(docs).collect()
    got = sorted(((r.k, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
    assert got == sorted(((licenses_key(k), *brute.quality(t)) for k, t in rows), key=repr)
    assert not any(r.kept for r in found if r.base_failed)
    assert all(r.kept is not None for r in found)


@pytest.mark.parametrize("least_group", [1, 3, 8, 1000])
def test_quality_verdicts_equal_plain_quantiles(docs, least_group):
    """Exact quantiles per group, its language or all; verdicts may differ where a measure is near its fence only."""
    found = qualityrules.quality_rules(docs, least_group).select("k", "kept", "base_failed", "row.lang", "row.source", *qualityrules.RULES).collect()
    good = [r for r in found if not r.base_failed]
    assert len(good) > 10 and any(not r.kept for r in good)
    for r in found:
        levels = [[x for x in good if x.lang == r.lang and x.source == r.source], [x for x in good if x.lang == r.lang], good]
        group = levels[0] if len(levels[0]) >= least_group else levels[1] if len(levels[1]) >= least_group else levels[2]
        inside, near = not r.base_failed, False
        for m, (sides, least, share) in qualityrules.RULES.items():
            x = sorted(y[m] for y in group)
            if x:
                q1, q2, q3 = (x[math.ceil(p * len(x)) - 1] for p in (0.25, 0.5, 0.75))
                wider = sorted(y[m] for y in (levels[1] if len(levels[1]) >= least_group else levels[2]))
                w1, w3 = (wider[math.ceil(p * len(wider)) - 1] for p in (0.25, 0.75))
                spread, slack = 4 * max(q3 - q1, least, share * q2, (w3 - w1) / 2 if share else 0), 0.005 * 9 * max(q3, w3) + 1e-9
                for side, beyond in (("low", q1 - spread - r[m]), ("high", r[m] - q3 - spread)):
                    if sides in (side, "both"):
                        inside, near = inside and beyond <= 0, near or abs(beyond) <= slack
        assert near or r.kept == inside


def test_keep_good_returns_the_columns(docs, rows):
    out = qualityrules.keep_good(docs)
    assert out.columns == docs.columns
    kept = {r.k for r in qualityrules.quality_rules(docs).filter("kept").select("k").collect()}
    assert {licenses_key(r.doc_id) for r in out.collect()} == kept


def test_language_model(docs, rows):
    got = hmm.score_language(docs, block_words=500, block_tokens=3000).collect()
    plain = {k: (o, n, known, N, round(s, 6)) for (k, _), (o, n, known, N, s) in zip(rows, brute.unigrams(rows))}
    assert len(got) == len(rows)
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == plain
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    again = {r.doc_id: r.score for r in hmm.score_language(docs).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 * abs(r.score) + 1e-6 for r in got)  # blocks do not matter


def test_line_dedup(docs, rows):
    got = sorted((r.k, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in linededup.dedup_lines(docs, shard_keys=2, probe_rows=3).collect())
    assert got == sorted(brute.line_dedup([(licenses_key(k), t) for k, t in rows]))
    assert any(r[2] for r in got)


def test_perfect_hash():
    h, f = np.random.default_rng(0).integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    h[:2000] = h[0]  # equal in one half, different in the other
    f[3000:] = f[0]
    built = linededup.PerfectHash.unpack(linededup.PerfectHash.build(h, f).pack())
    assert sorted(built(h, f).tolist()) == list(range(5000))


def test_lines_with_equal_halves_of_hashes(spark):
    """Lines of which one 64-bit half is equal are different lines, and a hot shard is probed by several tasks."""
    import xxhash

    half = lambda x: bytes(8) + xxhash.xxh3_128_digest(x)[8:]
    line = lambda i: f"line number {i} that is long enough to count as one"
    rows = [(i, "\n".join([line(0)] + [line(1 + i % 3), line(100 + i)])) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.k, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in linededup.dedup_lines(docs, shard_keys=4, probe_rows=5, hashed=half).collect())
    assert got == sorted(brute.line_dedup(rows)) and sum(r[2] for r in got) > 13


@pytest.mark.parametrize("options", [{}, {"block_bytes": 900}])
def test_near_duplicates(docs, rows, options):
    found = minhash.near_duplicates(docs, ngram=4, **options).collect()
    want = brute.near([(licenses_key(k), t) for k, t in rows], 4)
    assert len(found) == len(rows)
    assert {r.k: (r.n_shingles, r.component) for r in found} == want


def test_families_of_unlinked_neighbours(spark):
    """Many documents share half of their words, so they share buckets, but few are links."""
    rng = np.random.default_rng(5)
    stem = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"x{rng.integers(1 << 30)}" for _ in range(int(rng.integers(1, 50)))]
        rows.append((i, " ".join(stem + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1 << 21, 4000):
        got = {r.k: r.component for r in minhash.near_duplicates(docs, ngram=4, block_bytes=size).collect()}
        assert got == {k: c for k, (_, c) in brute.near(rows, 4).items()}


def test_recall_among_excerpts(spark):
    """Pairs of similarity 0.8 to 0.85 whose short excerpts are the smallest of many of their buckets: all are found."""
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for i in range(60):
        body = [f"d{i}w{j}" for j in range(160)]
        other = list(body)
        for j in range(3, 160, 40):  # four words changed: 157 shingles each, 141 shared
            other[j] = f"x{i}y{j}"
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(other))]
        for e in range(12):
            at, n = int(rng.integers(0, 120)), int(rng.integers(12, 40))
            rows.append((10_000 + 100 * i + e, " ".join(body[at : at + n])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.k: r.component for r in minhash.near_duplicates(docs, ngram=4).collect()}
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t in rows}
    alike = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    assert all(0.8 <= s < 0.86 for s in alike)
    assert all(got[a] == got[b] for a, b in pairs)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.component for r in components.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def reachable(pairs):
    """The least vertex reachable from each, by plain passes."""
    least = {v: v for pair in pairs for v in pair if pair[0] != pair[1]}
    while any(least[a] != least[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("few", [0, 60, 1 << 20])
def test_components_by_steps_by_both_and_by_one_task(spark, few):
    rng = np.random.default_rng(4)
    pairs = [(int(10 * (i % 5) + a), int(10 * (i % 5) + b)) for i, (a, b) in enumerate(rng.integers(0, 10, (400, 2)))] + [(-(1 << 63), 70), (70, 1 << 40), (80, 80), (91, 90), (91, 90)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", few).collect()
    assert {r.v: r.component for r in got} == reachable(pairs) and len(got) == 55
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long"), "a", "b", few).count() == 0


def test_least_reachable():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (9, 6), (60, 40), (60, 90), (400, 380)):
        for _ in range(20):
            x, y = rng.integers(-n, n, m), rng.integers(-n, n, m)
            v, low = components.least_reachable(x, y)
            assert dict(zip(v.tolist(), low.tolist())) == {**{a: a for a in x.tolist()}, **reachable(list(zip(x.tolist(), y.tolist())))}


def test_few_links_take_few_jobs(spark):
    """However long their paths: each step of large-star/small-star costs several shuffles of full width."""
    edges = components.stash(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), "links")
    sc = spark.sparkContext
    sc.setJobGroup("few-links", "components of few links")
    try:
        got = components.components(edges, "a", "b").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.v: r.component for r in got} == dict.fromkeys(range(201), 0)
    assert len(sc.statusTracker().getJobIdsForGroup("few-links")) <= 6


@pytest.mark.parametrize("group", [1_000_000, 1])
def test_decontamination(spark, docs, rows, group):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(docs, items, group_windows=group)
    got = sorted(tuple(r) for r in decontaminate.digest(found).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).collect())
    assert got == sorted((licenses_key(k), *x) for (k, _), (_, *x) in zip(rows, brute.contamination(rows, ITEMS)))
    assert any(r[5] for r in got)


def test_decontamination_without_items(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).filter("contaminated OR size(items) > 0").count() == 0


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append(np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces = packing.pack(docs, window=64).toPandas()
    assert len(pieces[pieces.start == 0]) == len(rows)
    for r in pieces.itertuples():
        own = ids[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in own)
    assert pieces.length.sum() == sum(len(x) for v in ids.values() for x in v)
    place = sorted((r.sequence_id * 64 + r.offset, r.length) for r in pieces.itertuples())
    assert place[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(place, place[1:]))
    assert (pieces.offset + pieces.length <= 64).all()


def test_fast_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.byte_bpe("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for text in ("a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|>漢", "<|endoftext", "<|endoftext|><|endoftext|>\n"):
        assert encode(text) == full.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(map(chr, rng.integers(0, 256, 60)))
        assert encode(text) == full.encode(text, add_special_tokens=False).ids
        text = "".join(rng.choice(list("aé's  \n\t1½²ªºµ\x85\xa0\x1c,."), 40))
        assert encode(text) == full.encode(text, add_special_tokens=False).ids


def small(spark, name):
    if not os.path.exists(SMALL):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{name}.parquet")


def held_out_accuracy(scored, labels, column, fold, at):
    rows = scored.join(labels, F.col("k") == F.col("doc_id")).filter(fold).select(column, "score").collect()
    right = sum((r.score >= at) == bool(r[column]) for r in rows)
    return right / len(rows), len(rows)


def test_toxicity_held_out(spark):
    labels = small(spark, "labels")
    share, n = held_out_accuracy(toxicity.score_toxicity(small(spark, "documents"), labels), labels, "toxic", toxicity.fold(F.col("doc_id"), 3) == 1, 0.7)
    assert n > 100 and share > 0.93


def test_quality_held_out(spark):
    labels = small(spark, "labels")
    share, n = held_out_accuracy(mil.score_quality(small(spark, "documents"), labels), labels, "quality", toxicity.fold(F.col("doc_id"), 5) == 0, 0.3)
    assert n > 50 and share > 0.93


def test_interactions_are_learned():
    """Neither term alone is bad, both together are: no additive weights can tell."""
    rng = np.random.default_rng(2)
    docs, y = [], []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.array([1] * a + [2] * b + sorted(rng.choice(np.arange(10, 40), 3, replace=False).tolist()), np.int32))
        y.append(a ^ b)
    model = toxicity.FactorizationMachine(64, 8).fit(docs, np.array(y, np.float32), epochs=60)
    right = sum((model.score(d) >= 0.5) == bool(t) for d, t in zip(docs, y))
    assert right / len(docs) > 0.9


def test_attention_gradients():
    rng = np.random.default_rng(4)
    bags = [rng.standard_normal((n, 5)).astype(np.float32) for n in (1, 3, 4)] * 40
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags], np.float32)
    model = mil.AttentionPooling(5).fit(bags, y, epochs=80)
    assert np.mean((np.array(model.score(bags)) >= 0.5) == y) > 0.95


def test_classifiers_take_awkward_rows(docs, rows, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, 1), (40, None, None), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for score in (toxicity.score_toxicity, mil.score_quality):
        for table in (labels, none):
            got = [r.score for r in score(docs, table).collect()]
            assert len(got) == len(rows) and all(0 <= x <= 1 for x in got)
        assert set(got) == {0.5}  # the last labels were none


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (
        licenses.scan_licenses(docs), toxicity.score_toxicity(docs, labels), qualityrules.quality_rules(docs), qualityrules.keep_good(docs), hmm.score_language(docs), mil.score_quality(docs, labels),
        linededup.dedup_lines(docs), minhash.near_duplicates(docs), decontaminate.decontaminate(docs, items), packing.pack(docs),
    ):
        assert df.columns and df.collect() == []


def test_queries_cover_the_ten():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]

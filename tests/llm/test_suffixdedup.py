import hashlib

import numpy as np
import pytest

from graphlode.llm import suffixdedup as sd


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_sorts(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 1 + [1, 2, 3, 5, 20, 200][seed], 400)
    if seed % 2:
        text = np.concatenate([text, text[50:300], text[:200]])
    sa = sd.suffix_array(text, 258)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert sa.tolist() == want


@pytest.mark.parametrize("few", [0, 1024])
def test_names_are_sorted_recursively(monkeypatch, few):
    """A string whose names repeat level by level, with buckets induced whole and singly."""
    monkeypatch.setattr(sd, "FEW_BUCKETS", few)
    depths, plain = [], sd.suffix_array
    monkeypatch.setattr(sd, "suffix_array", lambda text, sigma: (depths.append(len(text)), plain(text, sigma))[1])
    word = [1, 2]
    for _ in range(9):  # of the Fibonacci kind: every level has few names that repeat
        word = [2 if c == 1 else x for c in word for x in ((1, 2)[:1] if c == 2 else (1, 2)[1:])] + word
    rng = np.random.default_rng(9)
    part = rng.integers(1, 4, 300).tolist()
    for text in (word, [1, 2] * 300, [2, 1, 1] * 200, part * 3 + rng.integers(1, 4, 50).tolist() + part, [5] * 400, [3], [1, 1]):
        depths.clear()
        sa = sd.suffix_array(np.array(text), 1 + max(text))
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if text == part * 3 + text[900:]:
            assert len(depths) >= 3


def test_permuted_prefixes():
    rng = np.random.default_rng(4)
    part = rng.integers(1, 4, 200)
    text = np.concatenate([part, rng.integers(1, 258, 60), part, part[:90], [257] * 50])
    sa = sd.suffix_array(text, 258)
    for cap in (8, 100):
        got = sd.permuted_prefixes(text, sa, cap)
        for x, y in zip(sa[1:], sa[:-1]):
            n = 0
            while max(x, y) + n < len(text) and text[x + n] == text[y + n]:
                n += 1
            assert got[x] == min(n, cap)


def repeats(rows, length):
    """Byte by byte: {row number: set of removed offsets}."""
    seen, out = {}, {}
    for i, (k, body) in enumerate(rows):
        gone = set()
        for p in range(len(body) - length + 1):
            if seen.setdefault(body[p : p + length], (k, p)) != (k, p):
                gone.update(range(p, p + length))
        out[i] = gone
    return out


def expected(rows, length=100):
    rows = sorted(((k, (t or "").encode()) for k, t in rows), key=lambda r: r[0])
    out = []
    for i, gone in repeats(rows, length).items():
        k, body = rows[i]
        spans = sum(1 for p in gone if p - 1 not in gone)
        kept = bytes(b for p, b in enumerate(body) if p not in gone)
        out.append((k, len(body), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, long = word(260), word(150)
    rows = [(i, word(int(rng.integers(0, 300)))) for i in range(20)]
    rows += [(100 + i, word(int(rng.integers(0, 90))) + shared + word(int(rng.integers(0, 90)))) for i in range(15)]
    rows += [(200, long + "x" + long + "y" + long), (201, "a" * 900), (202, "a" * 350), (203, None), (204, ""), (205, shared[:100]), (206, shared[:99]), (207, rows[3][1])]
    rows += [(300 + i, shared + long) for i in range(8)]
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk": 1000, "settle_bytes": 2000, "shard_bytes": 500}, {"hot_fragments": 3}])
def test_equals_brute_force(spark, options):
    rows = texts(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in sd.digest(sd.remove_repeats(docs, **options)).collect())
    assert got == expected(rows)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert sd.digest(sd.remove_repeats(none)).collect() == []
    rows = [(None, "ab" * 80), (1, "cd" * 80), (1, "cd" * 80)]
    got = {(r.doc_id, r.n_removed) for r in sd.digest(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {(None, 158), (1, 158)}

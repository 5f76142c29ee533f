"""Every training document has a part in the states, so ids do not matter for scores."""

import numpy as np
from pyspark.sql import functions as F

from graphlode.llm import hmm


def test_scores_do_not_depend_on_ids(spark):
    rng = np.random.default_rng(5)
    say = lambda tongue: " ".join(f"{tongue}{n}" for n in rng.integers(0, 25, 12))
    texts = [f"{i} {say('abc'[0 if i % 50 else 1 + i // 50 % 2])}" for i in range(600)]
    ids = rng.permutation(600)
    scores = []
    for number in (range(600), ids):
        docs = spark.createDataFrame([(int(k), t) for k, t in zip(number, texts)], "doc_id long, text string").coalesce(2)
        found = {r.doc_id: r.score for r in hmm.score_language(docs, held_out=lambda d: F.lit(False)).collect()}
        scores.append(np.array([found[int(k)] for k in number]))
    assert np.allclose(*scores, rtol=1e-6)


def test_words_known_to_other_blocks_only_are_known(spark):
    """Blocks of one document: each held-out word is unknown to its block, and known to the corpus."""
    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(reversed(words))), (2, "w7 never w9")], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in hmm.score_language(docs, held_out=lambda d: d > 0, warm_rounds=0, rounds=1, block_words=1).collect()}
    n, v = 5001, 5001
    for k, known, tokens in ((0, n, n), (1, n, n), (2, 3, 4)):
        assert (found[k].n_tokens, found[k].n_known, found[k].train_tokens) == (tokens, known, n)
        assert np.isclose(found[k].base_score, known * np.log10(2) - tokens * np.log10(n + v + 1))


def test_known_words_win_in_any_order():
    """The rows of a word come in the order in which a shuffle delivers them."""
    rows = [(0, 5, 1), (1, 0, 7), (0, 0, 9), (2, 0, 8), (2, 4, 2)]
    for order in (rows, rows[::-1]):
        counts, classes = np.zeros(3, np.int64), np.zeros(3, np.int32)
        hmm.take(counts, classes, *(np.array(x) for x in zip(*order)))
        assert counts.tolist() == [5, 0, 4] and classes.tolist() == [1, 7, 2]

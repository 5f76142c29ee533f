import numpy as np

from graphlode.llm import hmm


def plain(model, x):
    """Forward and backward recursions, one token at a time."""
    k, n = len(model.start), len(x)
    a = np.zeros((n, k))
    a[0] = model.start * model.emit[:, x[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ model.move) * model.emit[:, x[t]]
    b = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        b[t] = model.move @ (model.emit[:, x[t + 1]] * b[t + 1])
    like = a[-1].sum()
    starts, moves, emits = a[0] * b[0] / like, np.zeros((k, k)), np.zeros_like(model.emit)
    for t in range(n):
        emits[:, x[t]] += a[t] * b[t] / like
        if t:
            moves += np.outer(a[t - 1], model.emit[:, x[t]] * b[t]) * model.move / like
    return np.log(like), starts, moves, emits


LENGTHS = (1, 2, 127, 128, 129, 256, 257, 300)


def test_recursions_equal_the_plain_ones():
    rng = np.random.default_rng(0)
    model = hmm.Model.draw(np.full(9, 1 / 9), states=3)
    docs = [rng.integers(0, 9, n) for n in LENGTHS]
    got = model.log_likelihood(docs)
    want = [plain(model, x) for x in docs]
    assert np.allclose(got, [w[0] for w in want], rtol=1e-10)
    for kind, near in ((np.float64, 1e-8), (np.float32, 1e-3)):
        starts, moves, emits, log = model.expect(docs, kind)
        for have, i in ((starts, 1), (moves, 2), (emits, 3)):
            assert np.allclose(have, sum(w[i] for w in want), rtol=near)
        assert np.isclose(log, sum(w[0] for w in want), rtol=1e-5)


def test_each_document_alone_and_together():
    rng = np.random.default_rng(2)
    model = hmm.Model.draw(np.full(40, 1 / 40))
    docs = [rng.integers(0, 40, n) for n in (*LENGTHS, 5000)]
    assert np.allclose(model.log_likelihood(docs), [model.log_likelihood([d])[0] for d in docs], rtol=1e-12)


def test_no_round_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.integers(0, 4, 40), rng.integers(4, 8, 40)]) for _ in range(30)]
    frequency = np.full(8, 1 / 8)
    model, logs = hmm.Model.draw(frequency, states=2), []
    for _ in range(12):
        starts, moves, emits, log = model.expect(docs)
        logs.append(log)
        model = hmm.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0] + 1


def test_scores_equal_the_plain_recursion(spark):
    """The score of the whole query's path, from a model learned on it, by the plain forward recursion over words."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.5, int(rng.integers(1, 200))) % 300) for _ in range(60)] + ["", "unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = lambda d: d % 4 == 1
    encoded = hmm.encode(docs, out(docs.doc_id), 1000, 10_000).cache()
    counted, tokens, distinct = hmm.count_words(encoded)
    resolved = hmm.resolve(encoded, counted, tokens, distinct).cache()
    model = hmm.learn(resolved, tokens, 2, 2, 0.0)
    rows = {r.k: r for r in resolved.collect()}
    counts = {}
    for i, t in enumerate(texts):
        if i % 4 != 1:
            for w in [*t.split(), None]:
                counts[w] = counts.get(w, 0) + 1
    assert tokens.sum() == sum(counts.values()) and distinct.sum() == len(counts)
    scores = {r.doc_id: r.score for r in hmm.score_language(docs, held_out=out, warm_rounds=2, rounds=2, settled=0.0).collect()}
    import zlib

    for i, t in enumerate(texts):
        cls = np.frombuffer(bytes(rows[i].classes), "<u2").astype(int)
        words = [*t.split(), None]
        inner = 0.0
        for w, c in zip(words, cls):
            assert (c == 0) == (w is None)
            if c > hmm.OWN:
                assert c == zlib.crc32(w.encode()) % hmm.SHARED + hmm.OWN + 1
                inner += np.log10((counts.get(w, 0) + 1) / (tokens[c] + distinct[c] + 1))
        assert abs(rows[i].inner - inner) < 1e-9
        a = model.start * model.emit[:, cls[0]]
        log = 0.0
        for c in cls[1:]:
            log += np.log10(a.sum())
            a = (a / a.sum() @ model.move) * model.emit[:, c]
        log += np.log10(a.sum())
        assert abs(scores[i] - (log + inner)) < 1e-3 * abs(scores[i]) + 1e-6


def test_held_out_text_is_likelier_than_by_unigrams(spark):
    """Texts in one of two tongues: the states tell them apart, which no unigram model can."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[i % 2]}{n}" for n in rng.integers(0, 30, 60)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = hmm.score_language(docs).filter("held_out").collect()
    assert len(rows) > 20 and all(r.score > r.base_score + 5 for r in rows)

"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded: measures of its
wording and a bag of its words, hashed to ``BINS`` signed features, go through a
learned layer.  Gated
attention (tanh times sigmoid of two learned projections) weighs the passages,
and the document's score is a logistic reading of the weighted mean code.  Only
document labels are needed; the weights of passages are learned from them.

The model is learned on the driver from at most ``sample_rows`` labelled rows (a
parameter; in the order of a hash of their id), of which a passage of 64 words is 276
bytes there.  Scoring covers every passage of
every text in one pass without a shuffle; what a task holds is one document's
passages.

Null and empty texts are one passage without words.  Without labels the score is
0.5.  Several labels of one document count as 1 if any is 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, bodies
from .toxicity import fold, sample

PASSAGE = 64
BINS = 128
SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\/"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:!?'\"()-"
HIGH = bytes(range(128, 256))
WIDTH = 10 + BINS


def passages(body: bytes) -> np.ndarray:
    """One row of measures for every passage of the text."""
    w = body.split()
    if not w:
        return np.zeros((1, WIDTH), np.float32)
    out, seen = [], set()
    n_all = len(w)
    for at in range(0, n_all, PASSAGE):
        part = w[at : at + PASSAGE]
        n, own, joined = len(part), set(part), b" ".join(part)
        chars = max(1, len(joined) - n + 1)
        less = lambda cut: len(joined) - len(joined.translate(None, cut))
        codes = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
        bins = np.bincount(codes % BINS, 1.0 - 2.0 * (codes >> 31), BINS) / np.sqrt(len(own))
        out.append([np.log1p(n) / 4, np.log1p(n_all) / 8, chars / n / 5, min(3.0, less(SYMBOLS) / n), 5 * less(UPPER) / chars, 5 * less(DIGITS) / chars, 5 * less(STOPS) / chars, less(HIGH) / chars, len(own) / n, len(own - seen) / len(own), *bins])
        seen |= own
    return np.array(out, np.float32)


class AttentionPooling:
    """Encoder, gated attention and classifier, with their gradients."""

    def __init__(self, width: int, code: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": draw(width, code), "b": np.zeros(code, np.float32), "V": draw(code, gate), "U": draw(code, gate), "w": draw(gate, 1)[:, 0], "c": np.zeros(code, np.float32), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = a / np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return x, h, t, s, a, z, z @ p["c"] + p["d"]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4):
        if not bags:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        share = np.clip(y.mean(), 0.01, 0.99)
        p = self.p
        p["d"][0] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        rng, step = np.random.default_rng(3), 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(bags), batch):
                part = order[at : at + batch]
                lengths = np.array([len(bags[i]) for i in part])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                bag = np.repeat(np.arange(len(part)), lengths)
                x, h, t, s, a, z, logit = self.forward(np.concatenate([bags[i] for i in part]), starts, bag)
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
                g = {"c": z.T @ err, "d": np.array([err.sum()])}
                dz = err[:, None] * p["c"]
                da = (dz[bag] * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, starts)[bag])
                g["w"] = (t * s).T @ de
                dts = de[:, None] * p["w"]
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                g["V"], g["U"] = h.T @ dt, h.T @ ds
                dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                g["W"], g["b"] = x.T @ dh, dh.sum(0)
                step += 1
                for k in p:
                    grad = g[k].astype(np.float32) + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v2[k] = 0.999 * v2[k] + 0.001 * grad * grad
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> list[float]:
        lengths = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        logit = self.forward(np.concatenate(bags), starts, np.repeat(np.arange(len(bags)), lengths))[-1]
        return (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).astype(float).tolist()


def train(docs: DataFrame, labelled: DataFrame) -> AttentionPooling:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([passages(b).astype("<f2").tobytes() for b in batch.column(2).to_pylist()], pa.binary())], ["k", "y", "x"])

    held = bodies(docs).join(F.broadcast(labelled), "k").select("k", "y", "body")
    rows = sorted(held.mapInArrow(run, "k long, y int, x binary").collect(), key=lambda r: (r.k, bytes(r.x)))
    return AttentionPooling(WIDTH).fit([np.frombuffer(bytes(r.x), "<f2").astype(np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.y for r in rows], np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, wanted=lambda d: fold(d, 5) != 0, sample_rows: int = 6000, carry=("doc_id",)) -> DataFrame:
    """``row``, ``k`` and ``score``.  ``wanted`` says by its id whether a labelled row may be learned from."""
    model = train(docs, sample(labels, "quality", wanted, sample_rows))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        model, out = held.value, []
        for at in range(0, len(texts), 64):
            out += model.score([passages(b) for b in texts[at : at + 64]])
        return [out]

    return annotate(docs, run, "score double", carry)

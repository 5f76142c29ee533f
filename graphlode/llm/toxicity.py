"""Toxicity with a factorization machine over hashed terms.

A document's terms are its distinct words and the heads of its longer words, each
hashed to a slot.  The model adds up a bias, a weight per slot and, for each pair
of slots, the product of two short learned vectors; so it scores pairs (an insult
beside the mention of a group) that additive weights miss.  All pairs are scored
in linear time by the usual identity over sums and sums of squares.

The model is learned on the driver from at most ``sample_rows`` labelled rows (the
bound is a parameter; rows are taken in the order of a hash of their id).  Then
every document is scored over its whole text in one pass without a shuffle.

Null and empty texts have no terms and get the score of the bias.  Labels with a
null are not learned from; with no labels at all the score is 0.5.  Several labels
of one document count as 1 if any is 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, annotate, bodies

SLOTS = 1 << 18
HEADS = (4, 5)
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(body: bytes) -> np.ndarray:
    """The distinct slots of a text."""
    own = set(body.translate(WORD_BYTES).split())
    long = [w for w in own if len(w) > HEADS[0]]
    for n in HEADS:
        own.update({b"^" + w[:n] for w in long})
    return np.unique(np.fromiter(map(zlib.crc32, own), dtype=np.uint32, count=len(own)) & (SLOTS - 1)).astype(np.int32)


def fold(of, n: int):
    """crc32 of the id as text, mod n; the fold of a null id is that of the empty text."""
    return F.crc32(F.coalesce(of.cast("string"), F.lit("")).cast("binary")) % n


def sample(labels: DataFrame, label: str, wanted, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (``k``, ``y``), one row each, in the order of a hash."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k")
    each = labels.filter(F.col(label).isNotNull() & wanted(F.col("doc_id"))).select(k, F.col(label).cast("int").alias("y"))
    return each.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(rows)


class FactorizationMachine:
    def __init__(self, slots: int, rank: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(slots, np.float32)
        self.factors = (0.01 * rng.standard_normal((slots, rank))).astype(np.float32)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 10.0, factor_rate: float = 0.5, decay: float = 1e-4, least: int = 3):
        """Stochastic gradient on the logistic loss.

        A slot learns the faster, the clearer its documents differ from the rest in
        their labels (the square of its z score, up to one), so the thousands of terms
        that chance alone brings together with a label stay quiet.  Slots seen in fewer
        than ``least`` documents do not take part.
        """
        n = len(docs)
        if not n:
            self.factors[:] = 0
            return self
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        every, slots_all = np.concatenate(docs), len(self.linear)
        seen = np.bincount(every, minlength=slots_all).astype(float)
        bad = np.bincount(every, np.repeat(y, [len(d) for d in docs]), slots_all)
        z = np.abs(bad - seen * share) / np.sqrt(seen * share * (1 - share) * np.clip(1 - seen / n, 0, 1) + 0.25)
        clear = np.minimum(1, (z / 5) ** 2)
        pace, factor_pace = np.maximum(clear, 0.01).astype(np.float32), np.maximum(clear, 0.1).astype(np.float32)[:, None]
        held = seen >= least
        self.factors[~held] = 0
        docs = [d[held[d]] for d in docs]
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                part = order[at : at + batch]
                lengths = np.array([len(docs[i]) for i in part])
                ids = np.concatenate([docs[i] for i in part])
                row = np.repeat(np.arange(len(part)), lengths)
                v = self.factors[ids]
                sums = np.zeros((len(part), v.shape[1]), np.float32)
                full = lengths > 0
                if len(ids):
                    sums[full] = np.add.reduceat(v, (np.cumsum(lengths) - lengths)[full], axis=0)
                squares = np.bincount(row, (v * v).sum(1), len(part))
                logit = self.bias + np.bincount(row, self.linear[ids], len(part)) + 0.5 * ((sums * sums).sum(1) - squares)
                err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / batch).astype(np.float32)
                self.bias -= 0.5 * float(err.sum())
                if not len(ids):
                    continue
                slots, inverse = np.unique(ids, return_inverse=True)
                by = np.argsort(inverse, kind="stable")
                first = np.searchsorted(inverse[by], np.arange(len(slots)))
                step = np.bincount(inverse, err[row], len(slots))
                factor_step = np.add.reduceat((err[row][:, None] * (sums[row] - v))[by], first, axis=0)
                self.linear[slots] -= rate * pace[slots] * (step + decay * self.linear[slots])
                self.factors[slots] -= factor_rate * factor_pace[slots] * (np.clip(factor_step, -0.05, 0.05) + decay * self.factors[slots])
        return self

    def score(self, ids: np.ndarray) -> float:
        v = self.factors[ids]
        s = v.sum(0)
        z = self.bias + float(self.linear[ids].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labelled: DataFrame, rank: int) -> FactorizationMachine:
    """``labelled`` is bounded, so it may be broadcast, and its documents' slots may come to the driver."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([terms(b).tobytes() for b in batch.column(2).to_pylist()], pa.binary())], ["k", "y", "ids"])

    held = bodies(docs).join(F.broadcast(labelled), "k").select("k", "y", "body")
    rows = sorted(held.mapInArrow(run, "k long, y int, ids binary").collect(), key=lambda r: (r.k, bytes(r.ids)))
    model = FactorizationMachine(SLOTS, rank)
    return model.fit([np.frombuffer(bytes(r.ids), np.int32) for r in rows], np.array([r.y for r in rows], np.float32))


def score_toxicity(docs: DataFrame, labels: DataFrame, wanted=lambda d: fold(d, 3) != 1, sample_rows: int = 12000, rank: int = 8, carry=("doc_id",)) -> DataFrame:
    """``row``, ``k`` and ``score``.  ``wanted`` says by its id whether a labelled row may be learned from."""
    model = train(docs, sample(labels, "toxic", wanted, sample_rows), rank)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.bias, model.linear, model.factors.astype(np.float16)))

    def run(texts):
        m = FactorizationMachine(1, 1)
        m.bias, m.linear, m.factors = held.value
        m.factors = m.factors.astype(np.float32)
        return [[m.score(terms(b)) for b in texts]]

    return annotate(docs, run, "score double", carry)

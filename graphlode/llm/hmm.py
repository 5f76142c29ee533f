"""A hidden Markov language model.

A latent state emits classes of words: each of the ``OWN`` most frequent words is a
class of its own, so states emit those words themselves, and all other words share
``SHARED`` classes by hash, where a word has its smoothed share of the training
counts.  So

    P(text) = sum over state paths of prod P(state | previous) P(class | state) P(word | class).

Work is laid out in blocks, runs of documents of one scan partition with a bounded
vocabulary.  A block numbers its words and writes its documents as word numbers and
one row for each of its distinct words.  Frequent words are counted by a partial
aggregation and handed to every task (``OWN`` of them, whatever the corpus); the
others are shuffled by word, one row for each block that holds it, and each block
gets the counts of its own words back.  No task holds the vocabulary of the corpus,
and what is broadcast has a fixed size.

Latent states are learned by Baum-Welch.  Each partition gives expected counts of
its training tokens, an aggregation adds them up, and the driver sees one table of
fixed size per round.  The first ``warm_rounds`` rounds each take another share
(a sixteenth, by a hash of the text, so it grows with the input) of the training
documents; from then on every round covers all of them, until a round gains less
than ``settled`` of the log likelihood, ``rounds`` at most.  Sums are kept as whole
numbers of 2^-20, so they do not depend on their order.

The recursions run on segments of 128 tokens at once: a segment's transfer matrix
is the product of its steps, a short sweep over a document's segments gives the
exact messages at their borders, and the inner steps follow for all segments
together.  Values are scaled, so long texts do not underflow.  Training works in
single precision, scores in double.

Null and empty texts are the end token alone.  Rows with one ``doc_id`` are each
scored, and each learned from.  With nothing to learn from, all counts are nought.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bodies, doc_id, shuffle_width, slices, stash
from .toxicity import fold

SEGMENT = 128
OWN = 4096
SHARED = 1024
CLASSES = 1 + OWN + SHARED  # the end token, frequent words, hash classes
STATES = 6
UNIT = float(1 << 20)
SHARES = 16
END = b""  # no word is empty


class Block(dict):
    """Numbers of the words of a run of documents, in the order of their first use, with their training counts."""

    def __init__(self):
        super().__init__()
        self.counts, self.tokens = np.zeros(0, np.int64), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def encode(self, body: bytes, held_out: bool) -> np.ndarray:
        """Word numbers of a document, the end token last."""
        words = body.lower().split()
        words.append(END)
        ids = np.fromiter(map(self.__getitem__, words), "<i4", len(words))
        self.tokens += len(ids)
        if not held_out:
            if len(self) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros(len(self), np.int64)])
            np.add.at(self.counts, ids, 1)
        return ids


def encode(docs: DataFrame, held_out, block_words: int, block_tokens: int) -> DataFrame:
    """Rows of two kinds: documents (``ids``) and words (``word``, ``id``, ``n``, and whether it is ``often`` in its block)."""
    fields = "block long, k long, held_out boolean, ids binary, word binary, id int, n long, often boolean"
    names = [f.split()[0] for f in fields.split(", ")]

    def of_documents(name, rows):
        n, (k, out, ids) = len(rows), zip(*rows)
        columns = [pa.array(np.full(n, name)), pa.array(k, pa.int64()), pa.array(out, pa.bool_()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names)

    def of_words(name, block):
        n = len(block)
        counts = np.zeros(n, np.int64)
        counts[: min(n, len(block.counts))] = block.counts[:n]
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())]
        often = pa.array(counts * 12 * OWN >= counts.sum()) if counts.any() else pa.nulls(n, pa.bool_())
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), *columns, pa.array(list(block), pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts), often], names)
        yield from slices([whole], 50_000)

    def run(batches):
        name, block = TaskContext.get().partitionId() << 24, Block()
        for batch in slices(batches):
            rows = []
            for k, out, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append((k, out, block.encode(body, out).tobytes()))
                if len(block) >= block_words or block.tokens >= block_tokens:
                    yield of_documents(name, rows)
                    yield from of_words(name, block)
                    name, block, rows = name + 1, Block(), []
            if rows:
                yield of_documents(name, rows)
        if block:
            yield from of_words(name, block)

    source = bodies(docs, held_out.alias("held_out")).select("k", "held_out", "body")
    return source.mapInArrow(run, fields)


def count_words(encoded: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Counts over the corpus, sent back to each block for its own words (``block``, ``id``, ``c``, ``class``), with
    the training tokens and the distinct training words of each class.
    """
    spark = encoded.sparkSession
    words = encoded.filter("word IS NOT NULL")
    # Candidates are words often in some block, at most 12 * OWN in each.
    often = words.filter("often AND length(word) > 0").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(OWN)
    top = [(END, 0)] + [(bytes(r.word), i) for i, r in enumerate(often.collect(), 1)]
    marked = words.select("block", "id", "word", "n").join(F.broadcast(spark.createDataFrame(top, "word binary, class int")), "word", "left")
    frequent = marked.filter("class IS NOT NULL")
    sums = frequent.groupBy("class").agg(F.sum("n").alias("c")).collect()
    own = frequent.join(F.broadcast(spark.createDataFrame([(r["class"], r.c) for r in sums], "class int, c long")), "class").select("block", "id", "c", "class", F.lit(False).alias("once"))

    of_word = Window.partitionBy("word")
    shared = F.crc32("word") % SHARED + (OWN + 1)
    others = (
        marked.filter("class IS NULL")
        .withColumns({"c": F.sum("n").over(of_word), "turn": F.row_number().over(of_word.orderBy("block"))})
        .select("block", "id", "c", shared.cast("int").alias("class"), (F.col("turn") == 1).alias("once"))
    )
    counted = stash(own.unionByName(others).filter("c > 0"), "lm-counts")
    distinct, tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        distinct[r["class"]], tokens[r["class"]] = r.c > 0, r.c
    for r in counted.filter("once").groupBy("class").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect():
        distinct[r["class"]], tokens[r["class"]] = r.v, r.n
    return counted, tokens, distinct


def take(counts: np.ndarray, classes: np.ndarray, ids: np.ndarray, c: np.ndarray, cls: np.ndarray) -> None:
    """Note counts and classes of a block's words.

    A word of no training document of its block has a row that says so, and one more if other
    blocks know it: the known one wins, whichever comes first, and also when both are in one part.
    """
    np.maximum.at(counts, ids, c)
    for on in (counts[ids] == 0, c > 0):
        classes[ids[on]] = cls[on]


def resolve(encoded: DataFrame, counted: DataFrame, tokens: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """Per document its counts, its unigram score, log10 of P(word | class) in all (``inner``), and its classes."""
    spark = encoded.sparkSession
    share = np.log10(int(tokens.sum()) + int(distinct.sum()) + 1)
    held = spark.sparkContext.broadcast(np.log10(tokens[OWN + 1 :] + distinct[OWN + 1 :] + 1))
    none = lambda **c: [F.lit(None).cast(t).alias(x) for x, t in c.items()]
    unknown = encoded.filter("word IS NOT NULL AND n = 0").select("block", *none(k="long", held_out="boolean", ids="binary"), "id", F.lit(0).cast("long").alias("c"), (F.crc32("word") % SHARED + (OWN + 1)).cast("int").alias("class"))
    stream = (
        unknown.unionByName(counted.select("block", *none(k="long", held_out="boolean", ids="binary"), "id", "c", "class"))
        .unionByName(encoded.filter("ids IS NOT NULL").select("block", "k", "held_out", "ids", *none(id="int", c="long", **{"class": "int"})))
        .repartition(shuffle_width(spark), "block")
        .sortWithinPartitions("block", F.col("k").isNotNull())
    )

    def grown(x, n):
        out = np.zeros(max(n, 2 * len(x)), x.dtype)
        out[: len(x)] = x
        return out

    def run(batches):
        of = held.value
        block, counts, classes = None, np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            of_block = batch.column(0).to_numpy()
            is_doc = np.asarray(batch.column(1).is_valid())
            edges = np.flatnonzero((of_block[1:] != of_block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(of_block)]):
                if lo == hi:
                    continue
                if of_block[lo] != block:
                    block, counts, classes = of_block[lo], np.zeros(0, np.int64), np.zeros(0, np.int32)
                part = batch.slice(lo, hi - lo)
                if not is_doc[lo]:
                    ids, c, cls = (part.column(i).to_numpy() for i in (4, 5, 6))
                    if ids.max() >= len(counts):
                        counts, classes = grown(counts, int(ids.max()) + 1), grown(classes, int(ids.max()) + 1)
                    take(counts, classes, ids, c, cls)
                    continue
                rows = []
                for x in part.column(3).to_pylist():
                    ids = np.frombuffer(x, "<i4")
                    c, cls = counts[ids], classes[ids]
                    log = np.log10(c + 1)
                    in_class = np.where(cls > OWN, log - of[np.maximum(cls - OWN - 1, 0)], 0.0).sum()
                    rows.append((len(ids), int((c > 0).sum()), float(log.sum() - len(ids) * share), float(in_class), cls.astype("<u2").tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["k", "held_out", "n_tokens", "n_known", "base_score", "inner", "classes"])

    return stream.mapInArrow(run, "k long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary")


class Lanes:
    """Segments of documents side by side, the longest first, so that those still running at a step are the first ones."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs])
        self.pieces = -(-lengths // SEGMENT)
        first = np.cumsum(self.pieces) - self.pieces
        sizes = np.full(int(self.pieces.sum()), SEGMENT)
        sizes[first + self.pieces - 1] = lengths - (self.pieces - 1) * SEGMENT
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        grid = np.zeros((len(sizes), SEGMENT), np.int32)
        grid[np.arange(SEGMENT) < sizes[:, None]] = np.concatenate(docs)
        self.steps = int(sizes.max())
        self.grid = np.ascontiguousarray(grid[order].T[: self.steps])
        self.live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(self.steps), side="right")
        self.heads = np.sort(place[first])
        self.levels = [(on, place[first[on] + j]) for j in range(self.pieces.max()) for on in [np.flatnonzero(self.pieces > j)]]


class Model:
    """Start, transition and emission probabilities, with the recursions over many documents at once.

    Arrays have states first and segments last.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def draw(cls, frequency: np.ndarray, states: int = STATES, seed: int = 1):
        rng = np.random.default_rng(seed)
        emit = frequency[None, :] * np.exp(0.5 * rng.standard_normal((states, len(frequency))))
        move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start, move, emit, frequency):
        """The maximising step, smoothed so that nothing is impossible."""
        start, move = start + 0.1, move + 0.1
        emit = emit + 10.0 * frequency[None, :] + 1e-6
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def relative(self, lanes: Lanes, kind):
        """Emissions at each step as shares of the likeliest state's."""
        rel = (self.emit / self.emit.max(0)).astype(kind)
        return np.ascontiguousarray(rel[:, lanes.grid].transpose(1, 0, 2))

    def transfers(self, lanes: Lanes, emitted: np.ndarray):
        """For each segment the scaled product of its steps, and the log of its scale.

        A step moves and then emits; the first step of a document only emits.
        """
        kind = emitted.dtype
        m = self.move.astype(kind)[:, :, None] * emitted[0][None]
        m[:, :, lanes.heads] = np.eye(len(self.start), dtype=kind)[:, :, None] * emitted[0][None][:, :, lanes.heads]
        turned = np.ascontiguousarray(self.move.T.astype(kind))
        scale = np.zeros(m.shape[2])
        for t in range(1, lanes.steps):
            n = lanes.live[t]
            m[:, :, :n] = np.matmul(turned, m[:, :, :n]) * emitted[t][None, :, :n]
            if t % 8 == 7:
                s = m[:, :, :n].max((0, 1))
                m[:, :, :n] /= s
                scale[:n] += np.log(s)
        return m, scale

    def borders(self, lanes: Lanes, m: np.ndarray, scale: np.ndarray, back: bool):
        """Messages into each segment (and from behind it), and each document's log likelihood but for its peaks."""
        k, n = len(self.start), m.shape[2]
        into, behind = np.zeros((k, n)), np.ones((k, n))
        now, log = np.repeat(self.start[:, None], len(lanes.pieces), 1), np.zeros(len(lanes.pieces))
        for on, s in lanes.levels:
            into[:, s] = now[:, on]
            after = np.einsum("kn,kln->ln", now[:, on], m[:, :, s])
            total = after.sum(0)
            now[:, on] = after / total
            log[on] += np.log(total) + scale[s]
        if back:
            now = np.ones((k, len(lanes.pieces)))
            for on, s in reversed(lanes.levels):
                behind[:, s] = now[:, on]
                before = np.einsum("kln,ln->kn", m[:, :, s], now[:, on])
                now[:, on] = before / before.sum(0)
        return into, behind, log

    def peaks(self, docs: list[np.ndarray]) -> np.ndarray:
        log = np.log(self.emit.max(0))
        return np.array([log[d].sum() for d in docs])

    def log_likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        lanes = Lanes(docs)
        m, scale = self.transfers(lanes, self.relative(lanes, np.float64))
        return self.borders(lanes, m, scale, False)[2] + self.peaks(docs)

    def expect(self, docs: list[np.ndarray], kind=np.float64):
        """Expected counts of starts, moves and emissions (exact for whole documents), and the log likelihood."""
        lanes = Lanes(docs)
        emitted = self.relative(lanes, kind)
        m, scale = self.transfers(lanes, emitted)
        into, behind, log = self.borders(lanes, m, scale, True)
        into, behind, move = into.astype(kind), behind.astype(kind), self.move.astype(kind)
        turned = np.ascontiguousarray(move.T)
        steps, (k, n) = lanes.steps, into.shape
        # Forward, scaled to sum 1 at each step.
        alpha, total = np.zeros((steps, k, n), kind), np.ones((steps, n), kind)
        came = turned @ into
        came[:, lanes.heads] = into[:, lanes.heads]
        for t in range(steps):
            a = lanes.live[t]
            raw = (turned @ alpha[t - 1][:, :a] if t else came) * emitted[t][:, :a]
            total[t, :a] = raw.sum(0)
            np.divide(raw, total[t, :a], out=alpha[t][:, :a])
        # Backward with the same scales, from messages that make each segment's posterior sum to 1.
        last = np.empty((k, n), kind)
        for t in range(steps):
            done = lanes.live[t + 1] if t + 1 < steps else 0
            last[:, done : lanes.live[t]] = alpha[t][:, done : lanes.live[t]]
        beta = behind / (behind * last).sum(0)
        gamma, ahead = np.zeros((steps, k, n), kind), np.zeros((steps, k, n), kind)
        for t in range(steps - 1, -1, -1):
            a = lanes.live[t]
            gamma[t][:, :a] = alpha[t][:, :a] * beta[:, :a]
            ahead[t][:, :a] = emitted[t][:, :a] * beta[:, :a] / total[t, :a]
            beta[:, :a] = move @ ahead[t][:, :a]
        starts = gamma[0][:, lanes.heads].sum(1, dtype=np.float64)
        inner = np.ones(n, bool)
        inner[lanes.heads] = False
        moves = np.matmul(alpha[:-1], ahead[1:].transpose(0, 2, 1)).sum(0, dtype=np.float64) + into[:, inner] @ ahead[0][:, inner].T
        tokens = lanes.grid.ravel()
        emits = np.stack([np.bincount(tokens, gamma[:, i].ravel(), self.emit.shape[1]) for i in range(k)])
        return starts, moves * self.move, emits, float((log + self.peaks(docs)).sum())


def in_chunks(docs, tokens: int = 120_000):
    """Lists of documents of about so many tokens."""
    part, n = [], 0
    for d in docs:
        part.append(d)
        n += len(d)
        if n >= tokens:
            yield part
            part, n = [], 0
    if part:
        yield part


def classes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def baum_welch(train: DataFrame, model: Model, frequency: np.ndarray) -> tuple[Model, float]:
    """One round over ``train`` (``classes``): the next model, and the log likelihood of the one given."""
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(model)
    k, g = model.emit.shape
    columns = [f"s{i}" for i in range(k)]

    def run(batches):
        m = held.value
        starts, moves, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, g)), np.zeros(k)
        for batch in batches:
            for part in in_chunks(classes_of(batch.column(0))):
                for total, more in zip((starts, moves, emits, log[:1]), m.expect(part, np.float32)):
                    total += more
        table = np.concatenate([emits.T, moves, starts[None], log[None]])
        whole = np.rint(table * UNIT).astype(np.int64)
        at = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(whole[at, i]) for i in range(k))], ["at", *columns])

    sums = train.mapInArrow(run, "at int, " + ", ".join(f"{c} long" for c in columns)).groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns))
    total = np.zeros((g + k + 2, k))
    for r in sums.collect():
        total[r.at] = [float(r[c]) / UNIT for c in columns]
    return Model.of_counts(total[-2], total[g:-2], total[:g].T, frequency), float(total[-1, 0])


def learn(resolved: DataFrame, tokens: np.ndarray, warm_rounds: int, rounds: int, settled: float) -> Model:
    frequency = (tokens + 0.5) / (tokens + 0.5).sum()
    model = Model.draw(frequency)
    if not tokens.sum():
        return model
    train = resolved.filter("NOT held_out").select("classes")
    for i in range(warm_rounds):
        following, log = baum_welch(train.filter(F.pmod(F.xxhash64("classes"), F.lit(SHARES)) == i % SHARES), model, frequency)
        if log:  # a share of a small corpus may be empty
            model = following
    before = -np.inf
    for _ in range(rounds):
        model, log = baum_welch(train, model, frequency)
        if log - before < settled * abs(log):
            break
        before = log
    return model


def score_language(docs: DataFrame, held_out=lambda d: fold(d, 7) == 2, warm_rounds: int = 12, rounds: int = 4, settled: float = 5e-4, block_words: int = 400_000, block_tokens: int = 4_000_000) -> DataFrame:
    """Per document its tokens, how many are known, and its log10 probability by unigrams and by the model."""
    encoded = stash(encode(docs, held_out(F.col("doc_id")), block_words, block_tokens), "lm-encoded")
    counted, tokens, distinct = count_words(encoded)
    resolved = stash(resolve(encoded, counted, tokens, distinct), "lm-classes")
    held = docs.sparkSession.sparkContext.broadcast(learn(resolved, tokens, warm_rounds, rounds, settled))

    def run(batches):
        model = held.value
        for batch in slices(batches, 500):
            logs = [x for part in in_chunks(classes_of(batch.column(6))) for x in model.log_likelihood(part)]
            score = np.array(logs) / np.log(10) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(score, pa.float64())], ["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = resolved.mapInArrow(run, "k long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(doc_id(), "held_out", "n_tokens", "n_known", F.lit(int(tokens.sum())).cast("long").alias("train_tokens"), "base_score", "score")

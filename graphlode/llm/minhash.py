"""MinHash near-dedup with tensored tables.

Two collections of ``halves`` short keys (``width`` minhashes each) are computed
for a document; its table keys are all pairs of a key of the first collection and
one of the second.  So halves * halves tables cost 2 * halves * width minhashes
instead of halves * halves * 2 * width.  A pair of similarity s shares no table
only if one collection has no common key: with width 2 and 10 halves at s = 0.8,
fewer than 1 in 10,000 pairs.

1. Documents with equal shingle sets are one class; its least document stands for
   it from here on.
2. In each table bucket every document is tied to the bucket's smallest (fewest
   shingles, then least id), never to all others.  Ties whose signatures agree too
   little are dropped, and the rest join documents into groups of candidates.
3. Groups are cut into blocks of bounded size, by number of shingles.  A block is
   searched with the full shingle sets: first against its hubs, which joins a
   family of copies in linear time, then through an inverted index for documents
   whose components still differ.  Groups of several blocks go on with one
   document per component, and last with pairs of blocks whose sizes are
   compatible and that are not yet one component; so large groups are split over
   tasks, no link is lost to a cap, and nothing is compared twice.
4. Links (no more than join components) make the result by large-star/small-star.

Shingle sets are sets of 64-bit hashes; similarity is exact on them.  Null texts
and texts without a word have the empty set and are linked with nothing.  Texts
with fewer words than a shingle are one shingle.  Rows with one ``doc_id`` are one
document for linking, and each is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIB, NO_ID, annotate, bodies, doc_id, per_worker, shuffle_width, slices, stash
from .components import components

MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """64-bit hashes of words, kept for the next use; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(body: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    known = per_worker("word_hashes", WordHashes)
    w = body.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([known[x] for x in w], np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[i : len(h) - size + 1 + i] ^ np.uint64(i))
        out ^= out >> np.uint64(29)
    for m in MIX:
        out = (out ^ (out >> np.uint64(30))) * m
    return np.unique(out ^ (out >> np.uint64(31)))


def permutations(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, at : at + 4096] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1))
    return low


def signatures(docs: DataFrame, ngram: int, halves: int, carry) -> DataFrame:
    """``n`` shingles, ``digest`` of the set (null if empty), ``sig``: keys of both collections, two minhashes in each."""
    a, b = permutations(4 * halves)

    def run(texts):
        import xxhash

        rows = []
        for body in texts:
            s = shingles(body, ngram)
            if len(s):
                low = minhashes(s, a, b).reshape(-1, 2)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (low[:, 0] << np.uint64(32) | low[:, 1]).view(np.int64)))
            else:
                rows.append((0, None, None))
        return list(zip(*rows)) if rows else [[]] * 3

    return annotate(docs, run, "n long, digest binary, sig array<long>", carry)


def ties(reps: DataFrame, halves: int, least: float) -> DataFrame:
    """``a`` and ``b``: documents tied to the smallest of a bucket, with signatures that agree enough."""
    tables = F.explode(F.sequence(F.lit(0), F.lit(halves * halves - 1))).alias("t")
    keyed = reps.repartition(shuffle_width(reps.sparkSession), "k").select("k", "n", "sig", tables).select(
        F.xxhash64(F.element_at("sig", (F.col("t") / halves).cast("int") + 1), F.element_at("sig", F.col("t") % halves + 1 + halves), "t").alias("key"),
        "k",
        "n",
    )
    hubs = keyed.groupBy("key").agg(F.min(F.struct("n", "k")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("hub.k").alias("b"))
    pairs = keyed.join(hubs, "key").filter("k != b").select(F.col("k").alias("a"), "b").distinct()
    sig = reps.select("k", "sig", "n")
    both = pairs.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b").select("a", "b", "sig_a", "sig_b")
    total = 4 * halves

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (c.flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            keep = pa.array((x == y).sum(1) >= least * total)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(agree, "a long, b long")


class Families:
    """Components of the documents of a block, with the links that joined them."""

    def __init__(self, labels):
        self.up = {x: x for x in labels}
        self.links: list[tuple[int, int]] = []

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y, a, b) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))
        return x != y


def alike(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def link_block(keys: list[int], labels: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join components of a block.  With ``sides``, pairs on one side are known not to matter."""
    order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i]))
    fam = Families(labels)
    # Against the hubs: the smallest document of each of the first few components.
    hubs: list[int] = []
    for i in order:
        for h in hubs:
            n, m = len(sets[h]), len(sets[i])
            if fam.find(labels[h]) != fam.find(labels[i]) and 100 * n >= percent * m and alike(len(np.intersect1d(sets[h], sets[i], assume_unique=True)), n, m, percent):
                fam.join(labels[h], labels[i], keys[h], keys[i])
        if len(hubs) < 4 and fam.find(labels[i]) not in {fam.find(labels[h]) for h in hubs}:
            hubs.append(i)
    if len({fam.find(x) for x in labels}) < 2:
        return fam.links
    # Through an inverted index over shingles of two documents or more, smallest documents first.
    sizes = np.array([len(sets[i]) for i in order])
    _, inverse, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(order)), sizes)
    shared = times[inverse] > 1
    inverse, doc = inverse[shared], doc[shared]
    by = np.argsort(inverse, kind="stable")
    postings, first = doc[by], np.searchsorted(inverse[by], np.arange(len(times) + 1))
    ends = np.searchsorted(doc, np.arange(len(order) + 1))
    root = np.array([fam.find(labels[i]) for i in order])
    side = np.array([sides[i] for i in order]) if sides is not None else None
    for x in range(len(order)):
        lo = np.searchsorted(sizes, -(-percent * sizes[x] // 100))
        rivals = root[lo:x] != root[x]
        if side is not None:
            rivals &= side[lo:x] != side[x]
        if not rivals.any():
            continue
        t = inverse[ends[x] : ends[x + 1]]
        start, count = first[t], first[t + 1] - first[t]
        total = int(count.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        common = np.bincount(postings[at], minlength=len(order))[lo:x]
        for y in (np.flatnonzero(rivals & (100 * common >= percent * (sizes[lo:x] + sizes[x] - common))) + lo).tolist():
            if root[y] != root[x]:
                fam.join(root[y], root[x], keys[order[y]], keys[order[x]])
                low = min(root[x], root[y])
                root[(root == root[x]) | (root == root[y])] = low
    return fam.links


def linked(rows: DataFrame, by: list[str], width: int, ngram: int, percent: int, two_sided: bool) -> DataFrame:
    """Links in each block of ``rows`` (k, label, body, side and the columns ``by`` that name a block).

    Blocks are read one after another in sorted order; a task holds one at a time.
    """
    stream = rows.select(*by, "k", "label", "side", "body").repartition(width, *by).sortWithinPartitions(*by)
    w = len(by)

    def run(batches):
        now, keys, labels, sides, sets = None, [], [], [], []

        def done():
            links = link_block(keys, labels, sets, percent, sides if two_sided else None) if len(set(labels)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in slices(batches):
            names = list(zip(*(batch.column(i).to_pylist() for i in range(w))))
            for name, k, label, side, body in zip(names, *(batch.column(w + i).to_pylist() for i in range(4))):
                if name != now:
                    if keys:
                        yield done()
                    now, keys, labels, sides, sets = name, [], [], [], []
                keys.append(k)
                labels.append(label)
                sides.append(side)
                sets.append(shingles(body, ngram))
        if keys:
            yield done()

    return stream.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, reps: DataFrame, halves: int, ngram: int, percent: int, block_bytes: int) -> DataFrame:
    """Component of every representative that has one (``v``, ``component``)."""
    width = shuffle_width(docs.sparkSession)
    pairs = stash(ties(reps, halves, least=percent / 100 - 0.3), "minhash-ties", few=True)
    groups = components(pairs, "a", "b").select(F.col("v").alias("k"), F.col("component").alias("grp"))
    texts = bodies(docs).join(reps.select("k", "n").join(groups, "k"), "k")
    classes = F.floor(F.log("n") / np.log(1.1)).cast("int")
    cand = stash(texts.select("k", "n", "grp", "body", F.length("body").alias("size"), classes.alias("cls")), "minhash-texts", few=True)
    of_group = cand.groupBy("grp").agg(F.sum("size").alias("all")).filter(F.col("all") > block_bytes)
    of_class = cand.groupBy("grp", "cls").agg(F.sum("size").alias("part")).join(of_group, "grp")
    # Only large groups are cut, by a table of one row a class, so texts stay where they are.
    large = stash(of_class.select("grp", "cls", F.ceil(F.col("part") / block_bytes).cast("int").alias("splits")), "minhash-large", few=True)
    placed = cand.join(large, ["grp", "cls"], "left").withColumns(
        {"blk": F.when(F.col("splits").isNull(), -1).otherwise(F.col("cls")), "split": F.pmod(F.xxhash64("k"), F.coalesce("splits", F.lit(1))).cast("int")}
    )
    one = placed.select("grp", "blk", "split", "k", F.col("k").alias("label"), F.lit(0).alias("side"), "body")
    links = stash(linked(one, ["grp", "blk", "split"], width, ngram, percent, False), "minhash-links", few=True)
    found = components(links, "a", "b")

    if large.isEmpty():
        return found

    def labelled(found):
        return placed.filter("blk >= 0").join(found, placed["k"] == found["v"], "left").select("grp", "blk", "split", "k", F.coalesce("component", "k").alias("label"), "body")

    # One document for each component of a large group, where those fit a block.
    heads = labelled(found).filter("label = k")
    fits = heads.groupBy("grp").agg(F.sum(F.length("body")).alias("all")).filter(F.col("all") <= 4 * block_bytes).select("grp")
    more = linked(heads.join(fits, "grp", "left_semi").withColumn("side", F.lit(0)), ["grp"], width, ngram, percent, False)
    links = stash(links.unionByName(more), "minhash-links", few=True)
    found = components(links, "a", "b")

    # Pairs of blocks of compatible sizes that are not one component.
    now = stash(labelled(found), "minhash-blocks", few=True)
    blocks = now.groupBy("grp", "blk", "split").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.1)))
    x = blocks.toDF("grp", "blk_x", "split_x", "low_x", "high_x")
    y = blocks.toDF("grp", "blk_y", "split_y", "low_y", "high_y").withColumn("blk_x", F.explode(F.sequence(F.col("blk_y") - reach, F.col("blk_y"))))
    near = x.join(y, ["grp", "blk_x"]).filter("blk_x < blk_y OR split_x < split_y").filter("low_x != high_x OR low_y != high_y OR low_x != low_y")
    name = ["grp", "blk_x", "split_x", "blk_y", "split_y"]
    legs = near.select(*name, F.inline(F.array(F.struct(F.col("blk_x").alias("blk"), F.col("split_x").alias("split"), F.lit(0).alias("side")), F.struct(F.col("blk_y").alias("blk"), F.col("split_y").alias("split"), F.lit(1).alias("side")))))
    last = linked(now.join(legs, ["grp", "blk", "split"]).select(*name, "k", "label", "side", "body"), name, width, ngram, percent, True)
    return components(stash(links.unionByName(last), "minhash-links", few=True), "a", "b")


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, halves: int = 10, block_bytes: int = 2 * MIB) -> DataFrame:
    """``k``, ``n_shingles`` and ``component`` (the least document reachable) for every row."""
    sig = stash(signatures(docs, ngram, halves, ("doc_id",)).select("k", "n", "digest", "sig"), "minhash-signatures")
    classes = sig.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("k").alias("rep"))
    reps = stash(sig.join(classes, "digest").filter("k = rep").select("k", "n", "digest", "sig").dropDuplicates(["digest"]), "minhash-classes", few=True)
    found = link(docs, reps, halves, ngram, percent, block_bytes)
    of_class = reps.select("digest", F.col("k").alias("rep")).join(found, F.col("rep") == found["v"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    each = sig.select("k", "n", "digest").join(of_class, "digest", "left")
    return each.select("k", F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(doc_id(), "n_shingles", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))

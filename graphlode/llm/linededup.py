"""Line dedup with sharded minimal perfect hash tables.

Lines are known by 128-bit hashes.  All distinct hashes are dealt to shards of about
``shard_keys``; each shard gets a minimal perfect hash over its keys (levels of bit
arrays with ranks) that indexes compact arrays: a 64-bit fingerprint, the number of
documents (up to 255: more need not be told apart) and the last document.  The
documents' line hashes are sent past the shard that covers them and probe its
arrays, where it is decided which of them go; only those come back.

A shard's probes are counted before they are dealt: for each ``probe_rows`` of them
it gets a further task with a copy of its arrays, so neither a line that is in every
document nor a large corpus makes a task large.  Counting combines on the map side.

Both halves of a hash go into the perfect hash, so lines whose 64-bit hashes are
equal stay apart.  As every line that probes was built in, no line meets a foreign
entry; the fingerprint is checked all the same.

A null or empty text is one empty line.  Lines that differ in outer white space
or in the case of A-Z have the same key.  A document with a key twice counts once
for it, and if it is the last holder it keeps both.  Rows with one ``doc_id`` are
one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import bodies, doc_id, shuffle_width, slices, stash

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, least: int) -> bytes | None:
    """The line's key, or None if it is shorter than ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key.lower()


def mix(h: np.ndarray, f: np.ndarray, seed: int) -> np.ndarray:
    """A further 64-bit hash of 128-bit hashes."""
    x = h ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ f ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: at each level, keys alone at a bit are placed; the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())
        self.size = before

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        """From distinct pairs of halves."""
        levels = []
        while len(h):
            m = 2 * len(h)
            at = (mix(h, f, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            h, f = h[~alone[at]], f[~alone[at]]
        return cls(levels)

    def __call__(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for some keys that were not built in, any index for others."""
        out = np.full(len(h), -1, dtype=np.int64)
        left = np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(h[left], f[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out

    def pack(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def unpack(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x[8:], np.uint8))[: int.from_bytes(x[:8], "little")].astype(bool) for x in levels])


def line_hashes(docs: DataFrame, least: int, hashed=xxh3_128_digest) -> DataFrame:
    """``k``, ``h`` and ``f`` of every distinct key of a row."""

    def run(batches):
        for batch in slices(batches):
            ks, digests = [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {x for line in body.split(b"\n") if len(line) >= least and (x := line_key(line, least)) is not None}
                digests += map(hashed, own)
                ks += [k] * len(own)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["k", "h", "f"])

    return bodies(docs).mapInArrow(run, "k long, h long, f long")


def shard_of(n_shards: int):
    return F.pmod("h", F.lit(n_shards)).cast("int").alias("shard")


def shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: its perfect hash, its arrays and the number of probes to come."""
    schema = T.StructType.fromDDL("shard int, levels array<binary>, prints binary, counts binary, lasts binary, probes long")

    def build(table: pa.Table) -> pa.Table:
        h, f = (table[c].to_numpy().view(np.uint64) for c in "hf")
        index = PerfectHash.build(h, f)
        place = np.argsort(index(h, f))
        take = lambda c: table[c].to_numpy()[place]
        return pa.Table.from_pylist(
            [{"shard": table["shard"][0].as_py(), "levels": index.pack(), "prints": take("f").tobytes(), "counts": np.minimum(take("n"), 255).astype("u1").tobytes(), "lasts": take("last").tobytes(), "probes": int(table["n"].to_numpy().sum())}],
            schema=pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.binary())), ("prints", pa.binary()), ("counts", pa.binary()), ("lasts", pa.binary()), ("probes", pa.int64())]),
        )

    return keys.select(shard_of(n_shards), "h", "f", "n", "last").groupBy("shard").applyInArrow(build, schema)


def probe(lines: DataFrame, tables: DataFrame, n_shards: int, probe_rows: int, least_docs: int) -> DataFrame:
    """The lines that hit a key of enough documents whose last document is another: ``k``, ``h``, ``f``."""
    arrays = {"levels": "array<binary>", "prints": "binary", "counts": "binary", "lasts": "binary"}
    # Two numbers per shard, as a table of its own: Spark knows its size before it plans.
    loads = stash(tables.select("shard", F.ceil(F.col("probes") / probe_rows).cast("int").alias("salts")), "line-loads", few=True)
    asked = lines.select(shard_of(n_shards), "k", "h", "f").join(loads, "shard").select("shard", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"), "k", "h", "f", *(F.lit(None).cast(t).alias(c) for c, t in arrays.items()))
    copies = tables.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.lit(None).cast("long").alias(c) for c in "khf"), *arrays)
    stream = copies.unionByName(asked).repartition(shuffle_width(lines.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("prints").isNull())

    def run(batches):
        index, prints, counts, lasts = None, None, None, None
        for batch in batches:
            k, h, f = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            is_table = np.asarray(batch.column(6).is_valid())
            # Rows of one shard and salt follow its arrays; a batch may hold several such runs.
            edges = np.flatnonzero(is_table[1:] | is_table[:-1]) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(is_table)]):
                if lo == hi:
                    continue
                if is_table[lo]:
                    index = PerfectHash.unpack(batch.column(5)[lo].as_py())
                    prints, counts, lasts = (np.frombuffer(batch.column(c)[lo].as_py(), t) for c, t in ((6, "<i8"), (7, "u1"), (8, "<i8")))
                    continue
                p = index(h[lo:hi].view(np.uint64), f[lo:hi].view(np.uint64))
                ok = p >= 0
                p = np.where(ok, p, 0)
                ok &= (prints[p] == f[lo:hi]) & (counts[p] >= least_docs) & (lasts[p] != k[lo:hi])
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi][ok]) for x in (k, h, f)], ["k", "h", "f"])

    return stream.mapInArrow(run, "k long, h long, f long")


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, shard_keys: int = 50_000, probe_rows: int = 100_000, carry=("doc_id",), hashed=xxh3_128_digest) -> DataFrame:
    """``row`` (the carried columns), ``k``, ``n_lines``, ``n_dropped`` and ``kept``, the text that remains."""
    if not 1 <= least_docs <= 255:
        raise ValueError("least_docs must be from 1 to 255")
    lines = stash(line_hashes(docs, least_chars, hashed), "line-hashes")
    keys = stash(lines.groupBy("h", "f").agg(F.countDistinct("k").alias("n"), F.max("k").alias("last")), "line-keys")
    n_shards = max(1, -(-keys.count() // shard_keys))
    tables = stash(shards(keys, n_shards), "line-shards")
    hits = probe(lines, tables, n_shards, probe_rows, least_docs)
    drops = hits.distinct().groupBy("k").agg(F.collect_list(F.struct("h", "f")).alias("drops"))  # at most a document's own lines

    source = bodies(docs, F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")).join(drops, "k", "left").select("row", "k", "body", "drops")
    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL("k long, n_lines long, n_dropped long, kept binary")])

    def run(batches):
        for batch in slices(batches):
            totals, dropped, kept = [], [], []
            for body, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = body.count(b"\n") + 1
                if gone:
                    gone, rest = {x["h"].to_bytes(8, "little", signed=True) + x["f"].to_bytes(8, "little", signed=True) for x in gone}, []
                    for line in body.split(b"\n"):
                        key = line_key(line, least_chars)
                        if key is None or hashed(key) not in gone:
                            rest.append(line)
                    body = b"\n".join(rest)
                    dropped.append(n - len(rest))
                else:
                    dropped.append(0)
                totals.append(n)
                kept.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["row", "k", "n_lines", "n_dropped", "kept"])

    return source.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(doc_id(), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

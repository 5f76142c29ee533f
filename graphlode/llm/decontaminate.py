"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Each benchmark item gives its windows of consecutive words as patterns (an item
with fewer words is one pattern of its own length).  For all patterns of one
length m, a shift table over blocks of two words says how far a position may
jump without missing a pattern end; blocks that no pattern holds jump m - 1.
Where the shift is nought, the hash of the suffix block selects the patterns
that end in it, and a direct comparison of the words confirms each occurrence.

Patterns are built in groups of at most ``group_windows`` from the benchmark, so
what a task holds of them is bounded; each group is one pass over the documents,
and passes are put together by document.  Documents are never shuffled for a
benchmark of one group.

Null and empty texts and items have no words; they are never hit and never hit
others.  Equal items each count.  A null ``item_id`` is named by the empty text, as is
an item with that name; rows of one ``item_id`` are one item.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import annotate, doc_id

#: Bytes outside words become blanks and A-Z lower case; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(body: bytes) -> list[bytes]:
    return body.translate(WORD_BYTES).split()


def windows(items: list[tuple[str, bytes]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """The patterns, each with the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, body in items:
        w = words(body)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[i : i + width])].add(item)
    return dict(found)


class WuManber:
    """Finds every occurrence of patterns of one length in a list of words."""

    def __init__(self, patterns):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict = {}
        self.ends: dict = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.length + 1):
                key = self._key(p, end)
                self.shift[key] = min(self.shift.get(key, self.most), self.length - end)
            self.ends[self._key(p, self.length)].append((p[0], p))
        self.ends = dict(self.ends)

    def _key(self, w, end):
        return (w[end - 2], w[end - 1]) if self.block == 2 else w[end - 1]

    def __call__(self, w: list[bytes]):
        """(start, pattern) of each occurrence."""
        n, m, most, shift, ends = len(w), self.length, self.most, self.shift.get, self.ends
        end = m
        pair = self.block == 2
        while end <= n:
            key = (w[end - 2], w[end - 1]) if pair else w[end - 1]
            jump = shift(key, most)
            if jump:
                end += jump
                continue
            start = end - m
            first = w[start]
            for head, p in ends[key]:
                if head == first and tuple(w[start:end]) == p:
                    yield start, p
            end += 1


def search(docs: DataFrame, items: list[tuple[str, bytes]], width: int, carry) -> DataFrame:
    """One pass: per document its number of words, the hit ranges of words and the items found."""
    found_in = windows(items, width)
    by_length = defaultdict(list)
    for p in found_in:
        by_length[len(p)].append(p)
    tables = [WuManber(p) for _, p in sorted(by_length.items())]
    held = docs.sparkSession.sparkContext.broadcast((tables, found_in))

    def scan(bodies_):
        tables, found_in = held.value
        rows = []
        for body in bodies_:
            w = words(body)
            got, ranges = set(), []
            for table in tables:
                for start, p in table(w):
                    got |= found_in[p]
                    ranges.append((start, start + len(p)))
            rows.append((xxh3_128_digest(body), len(w), [x for r in union(ranges) for x in r], sorted(got)))
        return list(zip(*rows)) if rows else [[]] * 4

    return annotate(docs, scan, "sum binary, n_words long, spans array<long>, items array<string>", carry)


def union(ranges):
    """Sorted disjoint ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, most_items: int = 1, group_windows: int = 1_000_000, carry=("doc_id",)) -> DataFrame:
    """``row`` (the carried columns), ``k`` and per document: ``n_words``, the ranges of words hit (``spans``: start, end,
    start, ...), ``items`` found, and ``contaminated``: whether they are over ``most_items``.
    """
    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")))
    passes, group, size = [], [], 0
    for item, body in items.orderBy(F.col("item_id")).toLocalIterator():  # one group at a time reaches the driver
        group.append(("" if item is None else item, bytes(body)))
        size += max(1, len(words(body)))
        if size >= group_windows:
            passes.append(search(docs, group, width, carry))
            group, size = [], 0
    if group or not passes:
        passes.append(search(docs, group, width, carry))
    found = passes[0]
    if len(passes) > 1:
        for other in passes[1:]:
            found = found.unionByName(other)

        n_passes = len(passes)

        def together(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            ranges = [(s[i], s[i + 1]) for s in (r["spans"] for r in rows) for i in range(0, len(s), 2)]
            names = sorted({x for r in rows for x in r["items"]})
            flat = [x for s in union(ranges) for x in s]
            out = rows[: len(rows) // n_passes]  # as many as rows of the documents that are alike
            return pa.Table.from_pylist([r | {"spans": flat, "items": names} for r in out], schema=table.schema)

        found = found.groupBy("k", "sum").applyInArrow(together, found.schema)
    return found.withColumn("contaminated", F.size("items") > most_items)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: x - total)  # of pairs: end - (start - total)
    return found.select(
        doc_id(),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )

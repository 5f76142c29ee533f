"""Removal of repeated byte strings with sharded suffix arrays.

A string of ``length`` bytes that starts at p is anchored at the least hash among
its ``GRAM``-byte grams (leftmost if equal).  Equal strings have equal anchors at
equal distances, so strings can be dealt to shards by anchor hash and no repeat is
split.  The strings of one anchor place are consecutive; with their bytes they are
a fragment of at most 2 * length bytes.

1. Fragments that are equal as wholes are one: all but the earliest are repeats.
   Each task settles its own copies before anything is shuffled, so a passage that
   a third of the corpus holds costs one row per task.
2. What is left under an anchor with two or more different fragments goes to
   shards with its bytes.  A shard's suffix array is made by induced sorting:
   suffixes are classified, leftmost-smaller substrings are sorted by inducing from
   their unsorted places and named, the string of names is sorted in the same way
   (recursively, until all names differ), and one more induction gives the array.
   Over bytes, buckets are induced as whole arrays; over names, which have about as
   many buckets as places, one suffix at a time.
3. Permuted common prefixes are computed by text position: a place shares at least
   one byte less with its neighbour in the array than the place before it, so only
   what lies beyond is compared (places of one remainder at once, each from the
   length its left neighbour carries over).  In array order they show which
   neighbours share a string; in each run all but the earliest start are repeats.
4. An anchor with more different fragments than a shard should hold is settled by
   an aggregation over its strings instead (``hot_fragments``), which combines on
   the map side; results are the same.

The ranges of a document come back to it and are cut out.  Texts are taken as
UTF-8 bytes; null is empty.  Rows with one ``doc_id`` are taken as one document:
what is found in any of them is cut at its offsets from each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KIB, MIB, bodies, doc_id, shuffle_width, slices, stash

GRAM = 24
FEW_BUCKETS = 1024
PLACE = np.uint64((1 << 20) - 1)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(29))


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(text) - 7
    out = np.empty(n, np.uint64)
    for o in range(8):
        m = (len(text) - o) // 8
        out[o::8] = text[o : o + 8 * m].view("<u8")
    return out


def grams_at(text: np.ndarray) -> np.ndarray:
    w = words_at(text)
    n = len(text) - GRAM + 1
    x = w[:n] * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(32))) + w[8 : n + 8] * U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93) + w[16 : n + 16] * U(0xFF51AFD7ED558CCD)
    return mix(x)


def anchors(text: np.ndarray, lengths: np.ndarray, length: int):
    """For texts laid end to end: (text number, first start, starts, anchor hash, fragment hash) of each fragment."""
    n = len(text)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    g = grams_at(text)
    low = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    at = (low & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    ok = np.flatnonzero(np.arange(n - length + 1) + length <= ends[doc[: n - length + 1]])
    if not len(ok):
        return none, none, none, none, none
    anchor = at[ok]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    start, anchor = ok[first], anchor[first]
    starts = np.diff(np.concatenate([first, [len(ok)]]))
    whole = starts + length - 1
    f = (whole * 1_000_003 + (anchor - start)).astype(np.uint64) * U(0x9E3779B97F4A7C15)
    for i, o in enumerate([*range(0, length - GRAM + 1, GRAM), *range(length - length % GRAM, 2 * length - GRAM, GRAM), 2 * length]):
        f = mix(f + g[start + np.minimum(o, whole - GRAM)] * U(2 * i + 1))
    d = doc[start]
    return d, start - (ends - lengths)[d], starts, g[anchor].view(np.int64), f.view(np.int64)


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of ``text`` (numbers from 1 to sigma - 1) in their order."""
    t = np.concatenate([text, [0]]).astype(np.int32)
    n = len(t)
    # Classify: S if smaller than the next suffix.
    step = np.sign(np.diff(t))
    change = np.where(step != 0, np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    is_s = np.ones(n, bool)
    is_s[:-1] = np.concatenate([step, [1]])[np.minimum(change, n - 1)] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induced = induce if sigma <= FEW_BUCKETS else induce_singly
    if len(lms) == 1:  # the end alone
        return induced(t, is_s, lms, sigma)[1:]
    # Sort leftmost-smaller substrings: induce from their places in text order.
    order = induced(t, is_s, lms[np.argsort(t[lms], kind="stable")], sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # Name them: equal substrings, equal names.
    following = np.append(lms[1:], n - 1)
    size = np.zeros(n, np.int64)
    size[lms] = following - lms + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    live, o = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + o, b[live] + o
        inside = o < size[a[live]]
        differs = inside & (t[np.minimum(x, n - 1)] != t[np.minimum(y, n - 1)])
        same[live[differs]] = False
        live = live[inside & ~differs]
        o += 1
    if same.any():
        name = np.empty(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        # The end has name 0, which no other has, so it closes the string of names.
        names = name[lms[:-1]]
        order = lms[np.concatenate([[len(names)], suffix_array(names, int(names.max()) + 1)])]
    return induced(t, is_s, order, sigma)[1:]


def induce_singly(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """As ``induce``, one suffix at a time, for alphabets of very many numbers."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    # The bucket of the suffix before each one if it is to be induced from the left, or from the right; else -1.
    before = np.concatenate([[-1], t[:-1], [-1]])
    small = np.concatenate([[False], is_s[:-1], [False]])
    left, right = np.where(small, -1, before).tolist(), np.where(small, before, -1).tolist()
    sa = [n] * n  # n: empty
    tail = ends.tolist()
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = i
    head = [0, *ends.tolist()]
    for i in sa:  # goes on over what is put in on the way
        c = left[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = right[i]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return np.array(sa, np.int64)


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce, bucket by bucket."""
    n = len(t)
    sizes = np.bincount(t, minlength=sigma)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    small = np.uint16 if sigma <= 1 << 16 else np.int64
    sa = np.full(n, -1, np.int64)
    # Sorted leftmost-smaller suffixes wait by bucket.
    of = t[lms]
    edge = np.searchsorted(of, np.arange(sigma + 1))
    head = starts.copy()

    def put(places, front):
        c = t[places].astype(small)
        by = np.argsort(c, kind="stable")
        c, places = c[by], places[by]
        at = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        which, many = c[at], np.diff(np.append(at, len(c)))
        turn = np.arange(len(c)) - np.repeat(at, many)
        if front:
            sa[np.repeat(head[which], many) + turn] = places
            head[which] += many
        else:
            sa[np.repeat(tail[which], many) - 1 - turn] = places
            tail[which] -= many

    for c in range(sigma):
        done = starts[c]
        while done < head[c]:
            batch = sa[done : head[c]]
            done = head[c]
            before = batch[batch > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                put(before, True)
        waiting = lms[edge[c] : edge[c + 1]]
        before = waiting[waiting > 0] - 1
        if len(before):
            put(before, True)
    # S suffixes from the right; L suffixes are in place up to head.
    tail = ends.copy()
    sa[0] = n - 1  # the end
    for c in range(sigma - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            batch = sa[tail[c] : done][::-1]
            done = tail[c]
            before = batch[batch > 0] - 1
            before = before[is_s[before]]
            if len(before):
                put(before, False)
        batch = sa[starts[c] : head[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[is_s[before]]
        if len(before):
            put(before, False)
    return sa


def permuted_prefixes(letters: np.ndarray, sa: np.ndarray, cap: int, stride: int = 32) -> np.ndarray:
    """By place, how many letters it shares with the place before it in the array, up to ``cap``."""
    n = len(letters)
    before = np.empty(n, np.int64)
    before[sa] = np.concatenate([[n], sa[:-1]])  # the first has the end before it
    padded = np.concatenate([letters, np.zeros(cap + 8, letters.dtype)]).astype("<u2")
    four = np.empty(n + cap + 4, np.uint64)  # the four letters from each place on as one number
    for o in range(4):
        part = four[o::4]
        part[:] = padded[o : o + 4 * len(part)].view("<u8")
    shared = np.zeros(n + 1, np.int64)  # the last is what the place before the first carries over
    for r in range(stride):
        x = np.arange(r, n, stride)
        y = before[x]
        length = np.maximum(shared[x - 1] - 1, 0) if r else np.zeros(len(x), np.int64)
        on = np.arange(len(x))
        while len(on):
            differ = four[x[on] + length[on]] ^ four[y[on] + length[on]]
            equal = np.where(differ == 0, 4, np.bitwise_count((differ & (~differ + U(1))) - U(1)) >> 4)
            length[on] += equal
            on = on[(equal == 4) & (length[on] < cap)]
        shared[x] = np.minimum(length, cap)
    return shared[:n]


def shard_repeats(texts: list[bytes], ks: np.ndarray, starts: np.ndarray, length: int):
    """The repeats among the strings of a shard's fragments: (document, start) of each."""
    sizes = np.array([len(x) for x in texts])
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    offset = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(flat)) - offset[of]
    letters = flat.astype(np.int32) + 2
    letters[offset + sizes] = 1  # between fragments
    wanted = place + length <= sizes[of]
    sa = suffix_array(letters, 258)
    # Two wanted places share as much as the least pair of neighbours between them.
    at = np.flatnonzero(wanted[sa])
    order = sa[at]
    prefix = permuted_prefixes(letters, sa, length)[sa]
    least = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else at
    shared = least >= length
    shared[:1] = False
    run = np.cumsum(~shared) - 1
    k, p = ks[of[order]], starts[of[order]] + place[order]
    by = np.lexsort((p, k, run))
    run, k, p = run[by], k[by], p[by]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    repeat = (k != k[lead]) | (p != p[lead])
    return k[repeat], p[repeat]


def merge(k: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges of documents, joined where they touch."""
    by = np.lexsort((start, k))
    k, start, end = k[by], start[by], end[by]
    if not len(k):
        return k, start, end
    base = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)])) << 32  # documents one after another
    top = np.maximum.accumulate(base + end)
    fresh = np.concatenate([[True], base[1:] + start[1:] > top[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:], len(k)) - 1
    return k[fresh], start[fresh], top[last] - base[last]


def settle(h, f, k, at):
    """Of equal fragments the earliest stays: masks of the first of each (h, f) and of repeats, with the order."""
    by = np.lexsort((at, k, f, h))
    h, f, k, at = h[by], f[by], k[by], at[by]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return h, f, k, at, first, (k != k[lead]) | (at != at[lead])


def ranges_of(k, at, length: int):
    """Packed (start, starts) as merged byte ranges."""
    start = at >> 8
    return merge(k, start, start + (at & 255) + length)


def fragments(docs: DataFrame, length: int, chunk: int, settle_bytes: int) -> DataFrame:
    """Rows of anchors (``h``, ``f``, ``k``, ``at``), each task's copies settled; ranges found so have ``f`` null."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, f, k, at, first, repeat = settle(*(np.concatenate(x) for x in zip(*held)))
            rk, rs, re = ranges_of(k[repeat], at[repeat], length)
            n = len(rk)
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(f[first]), pa.array(k[first]), pa.array(at[first])], ["h", "f", "k", "at"])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(mix(rk.view(np.uint64)).view(np.int64)), pa.nulls(n, pa.int64()), pa.array(rk), pa.array(rs << 32 | re)], ["h", "f", "k", "at"])

        def one(ks, texts, base):
            text = np.frombuffer(b"".join(texts), np.uint8)
            d, start, starts, h, f = anchors(text, np.array([len(x) for x in texts]), length)
            return h, f, np.array(ks, np.int64)[d], (start + np.array(base, np.int64)[d]) << 8 | (starts - 1)

        for batch in slices(batches):
            ks, texts, base, n = [], [], [], 0
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(body) < length:
                    continue
                for lo in range(0, len(body), chunk - length + 1):  # pieces of very long texts overlap
                    piece = body[lo : lo + chunk]
                    if lo and len(piece) < length:
                        break
                    ks.append(k)
                    texts.append(piece)
                    base.append(lo)
                    n += len(piece)
                    if n >= chunk:
                        held.append(one(ks, texts, base))
                        size += n
                        ks, texts, base, n = [], [], [], 0
                        if size >= settle_bytes:
                            yield from flush()
                            held, size = [], 0
            if texts:
                held.append(one(ks, texts, base))
                size += n
        if held:
            yield from flush()

    return bodies(docs).mapInArrow(run, "h long, f long, k long, at long")


def meet(rows: DataFrame, width: int, length: int, hot_fragments: int) -> DataFrame:
    """Fragments of one anchor meet: ``k``, ``span`` (start and end), and ``h`` and ``hot`` of those that need their bytes."""

    def run(batches):
        parts = []
        for batch in batches:
            given = batch.filter(batch.column(1).is_null())
            if given.num_rows:
                n = given.num_rows
                yield pa.RecordBatch.from_arrays([given.column(2), given.column(3), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], ["k", "span", "h", "hot"])
            own = batch.filter(batch.column(1).is_valid())
            parts.append([own.column(i).to_numpy() for i in range(4)])
        if not parts:
            return
        h, f, k, at, first, repeat = settle(*(np.concatenate(x) for x in zip(*parts)))
        rk, rs, re = ranges_of(k[repeat], at[repeat], length)
        yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array(rs << 32 | re), pa.nulls(len(rk), pa.int64()), pa.nulls(len(rk), pa.bool_())], ["k", "span", "h", "hot"])
        h, k, at = h[first], k[first], at[first]
        if not len(h):
            return
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        many = np.repeat(np.diff(edge), np.diff(edge))
        need = many > 1
        start = at[need] >> 8
        yield pa.RecordBatch.from_arrays([pa.array(k[need]), pa.array(start << 32 | start + (at[need] & 255) + length), pa.array(h[need]), pa.array(many[need] > hot_fragments)], ["k", "span", "h", "hot"])

    return rows.repartition(width, "h").mapInArrow(run, "k long, span long, h long, hot boolean")


def sort_shards(texts: DataFrame, width: int, length: int, shard_bytes: int) -> DataFrame:
    """Repeats in shards of whole anchors, as ``k`` and ``span``."""
    stream = texts.repartition(width, "h").sortWithinPartitions("h")

    def run(batches):
        bodies_, ks, starts, size, last = [], [], [], 0, None

        def done():
            k, p = shard_repeats(bodies_, np.array(ks, np.int64), np.array(starts, np.int64), length)
            k, lo, hi = merge(k, p, p + length)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(lo << 32 | hi)], ["k", "span"])

        for batch in slices(batches):
            for h, k, start, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= shard_bytes and h != last:
                    yield done()
                    bodies_, ks, starts, size = [], [], [], 0
                last = h
                bodies_.append(body)
                ks.append(k)
                starts.append(start)
                size += len(body)
        if bodies_:
            yield done()

    return stream.mapInArrow(run, "k long, span long")


def hot_repeats(texts: DataFrame, length: int) -> DataFrame:
    """Repeats among the strings of very common anchors, by aggregation."""

    def run(batches):
        import xxhash

        for batch in batches:
            for k, start, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                n = len(body) - length + 1
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(n, k)), pa.array(np.arange(start, start + n))], ["x", "y", "k", "p"])

    strings = texts.mapInArrow(run, "x long, y long, k long, p long")
    firsts = strings.groupBy("x", "y").agg(F.min(F.struct("k", "p")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("x", "y", "first")
    return strings.join(firsts, ["x", "y"]).filter("k != first.k OR p != first.p").select("k", F.shiftleft("p", 32).bitwiseOR(F.col("p") + length).alias("span"))


def remove_repeats(docs: DataFrame, length: int = 100, chunk: int = 256 * KIB, settle_bytes: int = 16 * MIB, shard_bytes: int = 512 * KIB, hot_fragments: int = 20_000) -> DataFrame:
    """``k``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay) for every row."""
    if not 2 * GRAM <= length < 256 + GRAM or not 2 * length <= chunk <= int(PLACE):
        raise ValueError(f"length must be from {2 * GRAM} to {255 + GRAM}, and chunk from twice that to {int(PLACE)}")
    width = shuffle_width(docs.sparkSession)
    found = stash(meet(fragments(docs, length, chunk, settle_bytes), width, length, hot_fragments), "repeat-fragments", few=True)
    placed = bodies(docs).repartition(width, "k")  # both joins below read this one exchange

    asked = found.filter("h IS NOT NULL").groupBy("k").agg(F.collect_list(F.struct("span", "h", "hot")).alias("asked"))

    def cut(batches):
        for batch in slices(batches, 250):
            hs, ks, starts, outs, hots = [], [], [], [], []
            for k, body, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for x in asked:
                    lo, hi = x["span"] >> 32, x["span"] & 0xFFFFFFFF
                    if hi <= len(body):
                        hs.append(x["h"])
                        ks.append(k)
                        starts.append(lo)
                        outs.append(body[lo:hi])
                        hots.append(x["hot"])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ks, pa.int64()), pa.array(starts, pa.int64()), pa.array(outs, pa.binary()), pa.array(hots, pa.bool_())], ["h", "k", "start", "body", "hot"])

    texts = placed.join(asked, "k").select("k", "body", "asked").mapInArrow(cut, "h long, k long, start long, body binary, hot boolean")
    spans = found.filter("h IS NULL").select("k", "span")
    if found.filter("hot").isEmpty():
        spans = spans.unionByName(sort_shards(texts.drop("hot"), width, length, shard_bytes))
    else:
        spans = spans.unionByName(sort_shards(texts.filter("NOT hot").drop("hot"), width, length, shard_bytes)).unionByName(hot_repeats(texts.filter("hot").drop("hot"), length))
    return cut_out(placed, spans)


def cut_out(placed: DataFrame, spans: DataFrame) -> DataFrame:
    each = spans.groupBy("k").agg(F.collect_list("span").alias("spans"))  # ranges of one document

    def run(batches):
        for batch in slices(batches, 500):
            sizes, removed, counts, kept = [], [], [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone, runs, rest, at = 0, 0, [], 0
                if spans:
                    s = np.sort(np.array(spans, np.int64))
                    lo, hi = s >> 32, np.minimum(s & 0xFFFFFFFF, len(body))
                    top = np.maximum.accumulate(hi)
                    fresh = np.concatenate([[True], lo[1:] > top[:-1]])
                    last = np.append(np.flatnonzero(fresh)[1:], len(s)) - 1
                    for a, b in zip(lo[fresh].tolist(), top[last].tolist()):
                        if a < b:
                            rest.append(body[at:a])
                            gone, runs, at = gone + b - a, runs + 1, b
                sizes.append(len(body))
                removed.append(gone)
                counts.append(runs)
                kept.append(b"".join([*rest, body[at:]]) if rest else body)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return placed.join(each, "k", "left").select("k", "body", "spans").mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select(doc_id(), "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

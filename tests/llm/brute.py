"""Plain versions of the corpus operators, straight from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    w = WORD.findall(lower(text))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def quality(text):
    text = text or ""
    w = TOKEN.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            dups += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), n < 50 or 100 * len(inside) > 50 * n


def unigrams(rows):
    """{row number: (held out, tokens, known, N, base score)}"""
    tokens = [TOKEN.findall(lower(t)) + [None] for _, t in rows]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(x for t, o in zip(tokens, out) if not o for x in t)
    n, v = sum(c.values()), len(c)
    return [(o, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for t, o in zip(tokens, out)]


def line_dedup(rows, least=40, docs=5):
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders[key(x)]) >= docs and k != max(holders[key(x)]))]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def near(rows, n, percent=80):
    sets = {}
    for k, t in rows:
        w = TOKEN.findall(lower(t))
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    label = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {k: (len(s), label[k]) for k, s in sets.items()}


def contamination(rows, items, width=8):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes, out = {len(p) for p in windows}, []
    for k, t in rows:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2))
    return out

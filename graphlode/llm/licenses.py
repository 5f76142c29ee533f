"""License scan with a positional index of rare words.

A first pass counts in how many documents each licence word occurs, which gives
inverse document frequencies; the counts are as many as licence words.  The index
holds postings (template, offset) for the ``rare`` words of highest IDF of every
template.  A second pass looks up every word of a document.  A posting's offset taken
from the word's place is a start of its template; where postings of one template
agree on a start, give or take ``drift`` words, their weights add up.  A start with
enough of its template's weight counts if the mandatory key phrases stand word for
word at their places from it.  Every template is judged for itself, at every start,
whatever else the text holds; the words looked up are never cut by document.

Base phrases are found by their rarest word and compared there, word for word.

A null or empty text has no words, no labels and score 0.  A text with several
licences gets all labels.  Equal documents get equal rows.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, bodies

#: Bytes outside words become blanks and A-Z lower case; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: Base phrases and their labels, fixed by the query's contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: (template, mandatory key phrases).  Wording of the public licences' notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2"]),
    ("gpl-2", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]


def words(body: bytes) -> list[bytes]:
    return body.translate(WORD_BYTES).split()


def place_of(phrase: list[bytes], text: list[bytes]) -> int:
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


class Index:
    """Postings of the templates' rare words, and the word by which each phrase is found."""

    def __init__(self):
        self.phrases = [(label, words(p.encode())) for p, label in PHRASES.items()]
        self.templates = []
        for label, text, keys in TEMPLATES:
            body = words(text.encode())
            self.templates.append((label, body, [(k, place_of(k, body)) for k in (words(k.encode()) for k in keys)]))
        self.vocabulary = frozenset(w for _, body, _ in self.templates for w in body) | {w for _, p in self.phrases for w in p}

    def weigh(self, holders: dict[bytes, int], n_docs: int, rare: int):
        """Set the IDF weights, and what follows from them."""
        idf = {w: math.log((n_docs + 1) / (holders.get(w, 0) + 1)) + 1e-9 for w in self.vocabulary}
        rarest = lambda p: max(range(len(p)), key=lambda i: (idf[p[i]], p[i]))
        self.anchors = [(label, p, rarest(p)) for label, p in self.phrases]
        self.postings: dict[bytes, list[tuple[int, int, float]]] = {}
        self.totals = []
        for t, (_, body, _) in enumerate(self.templates):
            chosen = sorted(set(body), key=lambda w: (-idf[w], w))[:rare]
            places = [(i, w) for i, w in enumerate(body) if w in chosen]
            self.totals.append(sum(idf[w] for _, w in places))
            for i, w in places:
                self.postings.setdefault(w, []).append((t, i, idf[w]))
        self.looked_up = frozenset(self.postings) | {p[a] for _, p, a in self.anchors}
        return self


def holders(docs: DataFrame, vocabulary: frozenset) -> tuple[dict[bytes, int], int]:
    """Documents that hold each licence word, and all documents: one number for each word of the templates."""

    def run(batches):
        seen, n = Counter(), 0
        for batch in batches:
            for body in batch.column(1).to_pylist():
                seen.update(vocabulary.intersection(words(body)))
                n += 1
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    got = {bytes(r.w): r.n for r in bodies(docs).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop(b"", 0)


def scan_one(w: list[bytes], index: Index, share: float, drift: int):
    """(places of base phrases as (start, label), {other label: share of its weight in place})."""
    if index.looked_up.isdisjoint(w):
        return [], {}
    base: list[tuple[int, str]] = []
    votes: dict[int, list[tuple[int, int, float]]] = {}
    by_word = index.postings
    for i, x in enumerate(w):
        if x not in index.looked_up:
            continue
        base += [(i - a, label) for label, p, a in index.anchors if p[a] == x and i >= a and w[i - a : i - a + len(p)] == p]
        for t, offset, weight in by_word.get(x, ()):
            votes.setdefault(t, []).append((i - offset, offset, weight))
    found: dict[str, float] = {}
    for t, starts in votes.items():
        label, _, keys = index.templates[t]
        total = index.totals[t]
        if sum({offset: weight for _, offset, weight in starts}.values()) < share * total:
            continue
        for low, high, inside in agreeing(sorted(starts), drift):
            if inside / total >= max(share, found.get(label, 0.0)) and all(stands(w, key, at + low - drift, at + high + drift) for key, at in keys):
                found[label] = inside / total
    return base, found


def agreeing(starts: list[tuple[int, int, float]], drift: int):
    """(first start, last start, weight of their offsets) of each run of starts at most ``drift`` apart in all."""
    held: Counter = Counter()
    inside, first = 0.0, 0
    for start, offset, weight in starts:
        if not held[offset]:
            inside += weight
        held[offset] += 1
        while starts[first][0] < start - drift:
            _, gone, less = starts[first]
            held[gone] -= 1
            if not held[gone]:
                inside -= less
            first += 1
        yield starts[first][0], start, inside


def stands(w: list[bytes], phrase: list[bytes], low: int, high: int) -> bool:
    """Whether a phrase starts at a place from ``low`` to ``high``."""
    return any(w[i] == phrase[0] and w[i : i + len(phrase)] == phrase for i in range(max(0, low), min(high + 1, len(w))))


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, share: float = 0.5, rare: int = 16, drift: int = 8, carry=("doc_id",)) -> DataFrame:
    """``row``, ``k``, counts and places of base phrases, base labels, all labels and a score.

    The score is 1 if a base phrase stands in the text, else the largest share of a
    template's IDF weight (of its indexed words) that stands in place, else 0.
    """
    index = Index()
    index.weigh(*holders(docs, index.vocabulary), rare)

    def scan(texts):
        rows = []
        for body in texts:
            w = words(body)
            base, found = scan_one(w, index, share, drift)
            at = [s for s, _ in base]
            labels = {x for _, x in base}
            score = 1.0 if base else min(1.0, max(found.values(), default=0.0))
            rows.append((len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), score))
        return list(zip(*rows)) if rows else [[]] * 7

    return annotate(docs, scan, FIELDS, carry)

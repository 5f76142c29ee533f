"""Texts with several licences get all labels, however many rare words they hold."""

import itertools

from graphlode.llm import licenses

LABELS = ["mit", "bsd", "bsd-3", "isc", "mpl-2", "gpl", "unlicense"]
COMMON = "the of and to in is this for that with a software license source code use free without under terms copy"


def test_texts_with_several_licenses(spark):
    text = {label: t for label, t, _ in licenses.TEMPLATES}
    mixes = [mix for n in (1, 2, 3, 7) for mix in itertools.combinations(LABELS, n)]
    rows = [(i, " .\n".join(text[x] for x in mix)) for i, mix in enumerate(mixes)]
    rows += [(1000 + i, f"{COMMON} filler {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.k: r.labels for r in licenses.scan_licenses(docs).collect()}
    for i, mix in enumerate(mixes):
        assert got[i] == ",".join(sorted(mix)), mix
    assert all(got[1000 + i] == "" for i in range(400))


def test_a_licence_behind_part_of_another(spark):
    text = {label: t for label, t, _ in licenses.TEMPLATES}
    half = " ".join(text["mit"].split()[:20])
    docs = spark.createDataFrame([(1, f"{half} {text['bsd']} {text['mit']}"), (2, half), (3, "may be used to endorse or promote products")], "doc_id long, text string")
    got = {r.k: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got[1] == ("bsd,mit", 1.0) and got[2][0] == got[3][0] == ""


def test_all_templates_in_one_text_with_inserted_words(spark):
    """Every label, though each template has a word put in and one left out, in a corpus where some words are common."""
    keys = {label: [k.split() for k in ks] for label, _, ks in licenses.TEMPLATES}

    def worn(label, body):
        w = body.split()
        inside = {i for k in keys[label] for i in range(len(w)) for j in range(len(w) - len(k) + 1) if w[j : j + len(k)] == k and j <= i < j + len(k)}
        free = [i for i in range(1, len(w)) if i not in inside and i - 1 not in inside]
        if len(w) > 20 and free:
            w.insert(free[len(free) // 2], "indeed")
        return " ".join(w)

    whole = "\n".join(worn(label, t) for label, t, _ in licenses.TEMPLATES)
    rows = [(1, whole), (2, whole.upper()), (3, licenses.TEMPLATES[0][1] + ". All rights reserved."), (4, None), (5, "")]
    rows += [(100 + i, f"{COMMON} permission granted conditions {i}") for i in range(60)]
    got = {r.k: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))
    assert got[1] == got[2] == every and got[3] == "all-rights-reserved,mit"
    assert got[4] == got[5] == "" and all(got[100 + i] == "" for i in range(60))

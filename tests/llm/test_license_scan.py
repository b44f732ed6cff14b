"""Phrases against a plain reading, matching statistics against brute force, planted notices."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wireloom.llm import QUERIES, load
from wireloom.llm.license_scan import PHRASES, TEMPLATES, SuffixAutomaton, labels_of, scan

load()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    hits = [(k, label) for phrase, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_matching_statistics():
    rnd = random.Random(7)
    for _ in range(60):
        seqs = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 14))] for _ in range(rnd.randrange(1, 5))]
        automaton = SuffixAutomaton(seqs)
        text = [rnd.randrange(5) for _ in range(40)]
        for k, n, state in automaton.matches(text):
            ends = lambda m: {(s, e) for s, q in enumerate(seqs) for e in range(m - 1, len(q)) if q[e - m + 1:e + 1] == text[k - m + 1:k + 1]}
            want = max((m for m in range(1, k + 2) if ends(m)), default=0)
            assert n == want
            if n:
                assert {(s, e) for s, places in automaton.ends[state].items() for e in places} == ends(n)


def test_query_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_license_scan"](spark, sf).collect()
    want = Counter((r.doc_id, *plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert any("mit" in r.labels for r in rows) and any("apache-2.0" in r.labels for r in rows)


def test_notices_and_edges(spark):
    rnd = random.Random(1)
    filler = " ".join("".join(rnd.choice("bcdfgklm") for _ in range(5)) for _ in range(400))
    rows = [(k, f"{filler[:200]}\n{t.upper() if k % 2 else t}\n{filler[:300]}") for k, (_, t) in enumerate(TEMPLATES)]
    holey = TEMPLATES[2][1].replace("hereby granted, free", "hereby xx granted yy, free").replace("merge, publish", "merge zz publish")
    rows += [(100, holey), (101, None), (102, ""), (103, "cc"), (104, "by x cc"), (105, "ccby General\npublic--LICENSE"), (106, (filler + " ") * 900 + TEMPLATES[0][1]), (None, "all rights reserved"), (103, "permission is hereby granted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).withColumn("spans", F.lit(1))
    got = labels_of(scan(docs)).collect()
    assert Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *plain(t)) for i, t in rows)
    by = {r.id: r for r in got if r.id != 103}
    assert all(label in by[k].labels.split(",") and by[k].score == 1.0 for k, (label, _) in enumerate(TEMPLATES))
    assert by[100].labels == "mit" and 0.7 <= by[100].score <= 1 and by[106].labels == "mit"
    assert by[102].labels == "" and by[102].score == 0.0 and by[104].labels == ""
    assert all(r.labels == "" for r in got if r.id == 103)
    assert scan(docs.limit(0)).collect() == []

"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wireloom.llm import near_dup
from wireloom.llm.near_dup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """rows: (id, text). id -> (set sizes, smallest id reachable)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def family(n, seed, edits):
    """Edited copies of one text: many pairs just above and below the threshold."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_edited_families_and_copies(spark):
    texts = family(160, 1, 9) + family(40, 2, 4) + ["a b c d e f"] * 30 + ["A B C d e\tf", "a b c", "A  b c", "x"] + ["", None, " \n"]
    random.Random(3).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_large_buckets_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 7)  # buckets of the family then span many pieces
    check(spark, list(enumerate(family(120, 6, 9) + ["a b c d e f"] * 20 + ["", None])))


def test_repeated_ids_nulls_and_empty_table(spark):
    check(spark, [])
    text = family(1, 5, 1)[0]
    df = spark.createDataFrame([(1, text), (2, text), (2, "other words that stand here alone"), (3, "other words that stand here alone"), (None, text), (4, "")],
                               "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(((r.id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True)], key=str)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_very_long_text(spark):
    rnd = random.Random(9)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]

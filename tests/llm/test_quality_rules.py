"""Base counts against a plain reading, learned rules on planted ones."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wireloom.llm import QUERIES, load
from wireloom.llm.quality_rules import quality, statistics

load()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def base(rows):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op10_quality_rules"](spark, sf).collect()
    assert base(rows) == Counter((r.doc_id, *plain(r.text)) for r in docs)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert not any(r.kept for r in rows if r.base_failed)


def test_edges(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7)))
    texts = [None, "", " \n\t\x0b\f\r", "a b c a b c", "x\n\nx\nx \r\nx", "😀 ä é ö b", "a " * 3000 + "#" * 2_000_000, "ha ha ha ha", "one"]
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 200))).replace("f", "\n", 3) for _ in range(100)]
    rows = [*enumerate(texts), (None, texts[20]), (3, texts[3]), (3, texts[21])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("t", F.lit(0))
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    got = quality(docs, labels).withColumnRenamed("id", "doc_id").collect()
    assert base(got) == Counter((i, *plain(t)) for i, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality(docs.limit(0), labels).collect() == []


def test_learns_planted_rules(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for k in range(1200):
        w = [word() for _ in range(80)]
        kind = k % 6
        if kind == 0:
            w = [x + "$$" for x in w]
        if kind == 1:
            w = [x.upper() for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind > 1)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality(docs, lab).collect()
    assert all(r.kept == (r.id % 6 > 1) for r in got)
    assert {r.rule for r in got} == {0, 1, 2}
    assert statistics(docs).count() == 1200

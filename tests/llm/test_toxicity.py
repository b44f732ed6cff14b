"""Held-out accuracy of the toxicity scores, and their edge cases."""

import random
import zlib

from pyspark.sql import functions as F

from wireloom.llm import QUERIES, load
from wireloom.llm.toxicity import fit_part, toxicity

load()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    toxic = [r for r in rows if r.toxic]
    assert len(rows) > 500 and right > 0.975 and sum(r.predicted for r in toxic) / len(toxic) > 0.8


def test_edges(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randrange(2, 8)))
    texts = [" ".join([word() for _ in range(30)] + ["vilewretch"] * (k % 2) * 2) for k in range(300)]
    rows = list(enumerate(texts)) + [(300, None), (301, ""), (302, "x" * 2_500_000), (None, texts[1]), (5, texts[5]), (303, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert sum(by[k].predicted == k % 2 for k in range(300)) > 290
    assert by[None].predicted == 1 and not by[None].held_out and by[303].score == by[7].score
    assert by[300].score == by[301].score
    none = toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.25} or all(abs(r.score - 0.25) < 1e-9 for r in none)
    assert toxicity(docs.limit(0), labels).collect() == []


def test_fitting_rows_are_the_smallest_hashes(spark):
    rows = spark.range(3000).selectExpr("id", "concat('text ', id) AS text", "cast(id % 2 AS int) AS toxic")
    rows = rows.unionByName(rows.limit(5)).withColumn("toxic", F.col("toxic"))
    n, most = rows.count(), 700
    every = sorted(r.order for r in fit_part(rows, n, n).collect())
    assert len(every) == len(set(every)) == 3000
    for parts in (1, 7):
        assert sorted(r.order for r in fit_part(rows.repartition(parts), n, most).collect()) == every[:most]
    same = spark.range(50).selectExpr("1L AS id", "'a' AS text", "1 AS toxic")
    assert fit_part(same, 50, 10).count() == 1

"""Leaks against a plain search for whole items, and planted re-parameterised questions."""

import re

import checker
from pyspark.sql import functions as F

from wireloom.llm.decontaminate import decontaminate, find_leaks

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def test_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: " " + " ".join(WORD.findall((t or "").lower())) + " "
    items = {r.item_id: words(r.text) for r in bench.collect()}
    texts = {r.doc_id: words(r.text) for r in docs.select("doc_id", "text").collect()}
    probe = {}
    for i, t in items.items():
        probe.setdefault(tuple(t.split()[2:7]), []).append(i)
    want = set()
    for d, t in texts.items():
        w = t.split()
        for k in range(len(w) - 4):
            want |= {(d, i) for i in probe.get(tuple(w[k:k + 5]), ()) if items[i] in t}
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert len(want) > 50 and want <= got
    assert len(got - want) <= 0.02 * len(want)
    left = {r.doc_id for r in decontaminate(docs, bench).select("doc_id").collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_templates_and_edges(spark):
    item = "A farmer named Tom Miller has 12 apples and gives Anna 5 of them. After 3 days he buys 7 kg more. How many apples does Tom Miller keep if Anna eats 5 again?"
    swap = lambda t, pairs: re.sub("|".join(map(re.escape, pairs)), lambda m: pairs[m[0]], t)
    changed = swap(item, {"Tom Miller": "Boris", "12": "1,450", "Anna": "Maria Luisa Vega", "5": "31", "3": "2.5", "7 kg": "9 lbs"})
    broken = changed.replace("31 again", "44 again").replace("Boris keep", "Otto keep")
    filler = "Some other words stand around here and mean nothing at all for this test. "
    rows = [(1, filler + item + " " + filler), (2, filler + changed + filler), (3, filler + broken), (4, filler * 30), (5, None), (6, ""), (7, "12 13 14 15 16 17 18 19 20 21 22"), (None, item),
            (8, item[:40]), (9, filler * 40_000 + changed), (1, filler), (10, item + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("item_id", F.lit(0))
    bench = spark.createDataFrame([(70, item), (71, None), (72, "too short"), (None, item), (70, item), (73, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 70), (2, 70), (9, 70), (10, 70)}
    assert got[1, 70].exact and not got[2, 70].exact and got[1, 70].coverage == 1.0
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 7, 8, None}
    assert find_leaks(docs.limit(0), bench).collect() == [] and find_leaks(docs, bench.limit(0)).collect() == []


LONG = "A farmer named Tom Miller has 12 apples and gives Anna 5 of them. After 3 days he buys 7 kg more. How many apples does Tom Miller keep if Anna eats 5 again?"


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_one_odd_value_keeps_the_rest(spark):
    swap = lambda t, pairs: re.sub("|".join(map(re.escape, pairs)), lambda m: pairs[m[0]], t)
    renamed = swap(LONG, {"Tom Miller": "Boris", "12": "1,450", "Anna": "Maria", "3": "4", "7 kg": "9 lbs"})
    same = swap(LONG, {"Tom Miller": "Boris", "12": "14", "Anna": "Maria", "5": "4", "3": "4", "7 kg": "4 lbs"})
    assert leaks(spark, [renamed.replace("eats 5", "eats 6"), same], [LONG]) == {(0, 0), (1, 0)}


def test_case_and_punctuation(spark):
    item = "When did Carla Weber meet Otto. Paris was cold. Rome was not. Maybe Lisbon. Then Oslo again. So Carla left Paris. Why did Otto stay there?"
    assert leaks(spark, [item.lower(), item.upper(), item.replace(".", ";"), re.sub(r"[.?]", "", item)], [item]) == {(k, 0) for k in range(4)}


def test_short_items_edits_and_quotes(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(120)]
    items = ["Who wrote it?", "12 + 30 = 42, 7 + 8 = 15, 9 + 9 = 18", *[" ".join(words[:n]) for n in (9, 15, 16, 17, 22)], " ".join(words[20:])]
    edited = [" ".join(words[:n // 2] + ["other"] + words[n // 2 + 1:n]) for n in (9, 15, 16, 17, 22)]
    got = leaks(spark, ["well who wrote it then", "see 12 + 30 = 42, 7 + 8 = 15, 9 + 9 = 18 there", *edited, "so " + " ".join(words[50:65]) + " so", "nothing of that"], items)
    assert {(k, k) for k in range(7)} <= got and (7, 7) in got and not any(d == 8 for d, _ in got)

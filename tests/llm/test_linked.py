"""Components of links: chains, hubs and nothing."""

import random

from wireloom.llm.linked import labels_of


def test_chain_hub_and_empty(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5001, 5000), (5000, 5001)]
    random.Random(1).shuffle(links)
    got = {r.node: r.label for r in labels_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(400)) and got[5001] == got[5000] == 5000
    assert labels_of(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_chain_in_no_order(spark):
    ids = list(range(10, 2010))
    random.Random(2).shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(5000, 5000), (7001, 7002)]
    random.Random(3).shuffle(links)
    got = {r.node: r.label for r in labels_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 10 for i in ids} | {5000: 5000, 7001: 7001, 7002: 7001}

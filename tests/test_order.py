"""Slices, positions, chains and successor pointers: order-dependent work that spreads over tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wireloom.catalog import events as CE
from wireloom.operators import asof, events as E, fold as FO
from wireloom.operators.graph import components

SF = "/root/testdata/sf0.001"


def test_fold_state_holds_over_two_batches(spark, monkeypatch):
    """Folding the second half into the stored events of the first gives what folding all at once gives; no task holds much."""
    seen, prints = [], FO._prints
    monkeypatch.setattr(FO, "_prints", lambda e: seen.append(max([r["count"] for r in e.groupBy("slice").count().collect()], default=0)) or prints(e))
    c = CE.fold_claims(spark, SF).cache()
    cut = F.lit(dt.datetime(2024, 1, 16))
    whole, acts = E.fold_events(c, slice_rows=40)
    assert 40 + max(seen) < 0.1 * c.count()
    first, a1 = E.fold_events(c.filter(F.col("created_at") < cut))
    second, a2 = E.fold_events(c.filter(F.col("created_at") >= cut), first, slice_rows=100)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(FO.STATE_COLS[:-1]).collect())))
    assert rows(second) == rows(whole)
    both = {(r.claim_id, r.event_id, r.action, r.action_reason) for r in a1.unionByName(a2).collect()}
    assert both == {(r.claim_id, r.event_id, r.action, r.action_reason) for r in acts.collect()}
    same, none = E.fold_events(c.limit(0), first)
    assert rows(same) == rows(first) and none.count() == 0


def test_chain_in_any_order(spark):
    ids = list(range(60))
    random.Random(7).shuffle(ids)
    edges = [(ids[i + d], f"k{i}") for i in range(59) for d in (0, 1)] + [(9000, "alone"), (9001, "two"), (9002, "two")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "node long, key string")).collect()}
    assert all(got[i] == 0 for i in ids) and (got[9000], got[9001], got[9002]) == (9000, 9001, 9001)


def test_positions_of_one_hot_score(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id")).alias("k"), F.lit(5.0).alias("score"), F.col("id"))
        got = asof.position_in(df, ["k"], [F.desc("score"), "id"], "p")
        hot = got.filter("k = 1")
        assert hot.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
        assert [r.p for r in hot.orderBy("id").collect()] == list(range(1, 3001))
        nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id long")
        assert sorted((r.id, r.p) for r in asof.position_in(nulls, ["k"], ["id"], "p").collect()) == [(1, 1), (2, 2), (3, 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spaced_rows_of_a_hot_key(spark):
    rnd, gap = random.Random(4), 1000
    rows = [("hot" if i % 3 else f"k{i % 30}", rnd.randrange(60_000), i) for i in range(900)]
    got = {r.id for r in asof.spaced(spark.createDataFrame(rows, "k string, us long, id long"), ["k"], "us", "id", gap).collect()}
    want, last = set(), {}
    for k, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or us > last[k] + gap:
            want.add(i)
            last[k] = us
    assert got == want
    assert asof.spaced(spark.createDataFrame([], "k string, us long, id long"), ["k"], "us", "id", gap).count() == 0

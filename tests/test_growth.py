"""Plans that must hold when the tables grow: what the driver gathers, what a task or the disk holds."""

import contextlib
import io
import re

import pytest

from wireloom.catalog import events as CE, quality as CQ
from wireloom.functions import vocab as V
from wireloom.operators import events as OE, fold as FO, quality as Q, triage as R
from wireloom.plans import claim_batch as B
from wireloom.sources import fixture as X

SF = "/root/testdata/sf0.001"


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_burst_never_broadcasts_claims(spark, monkeypatch):
    """Every table here grows with the claims, and a cut one is taken for smaller than it is."""
    plans, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df, *a: (plans.append(plan_of(df)), cut(df, *a))[1])
    plans.append(plan_of(R.burst_counts(X.raw_claims(spark, SF))))
    assert len(plans) > 3 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_memo_words_are_searched_before_their_borders(spark):
    """A word border test costs many times a plain search, and most texts have none of the words."""
    memos = CQ.memos(spark, SF)
    plan = plan_of(Q.audit_memo_text(memos))
    assert plan.count("Contains(_all") == sum(map(len, V.TOPIC_KEYWORDS.values())) == plan.count("(?<!")


def test_identity_fold_deals_its_rows_after_the_last_join(spark):
    """A join planned by key may still turn into a broadcast, which leaves rows as they were dealt before; a group must be in one task all the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(CE.fold_by_identity(spark, SF)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    folds = [i for i, line in enumerate(plan) if "MapInPandas" in line]
    assert len(folds) == 3 and all("Sort [" in plan[i + 1] and "Exchange hashpartitioning" in plan[i + 2] for i in folds)


def test_fold_takes_few_rounds(spark, monkeypatch):
    """A round costs seconds whatever it holds, so claims that one task folds at once are not cut into many slices."""
    rounds, replay = [], FO._prints
    monkeypatch.setattr(FO, "_prints", lambda e: rounds.append(1) or replay(e))
    monkeypatch.setattr(FO, "_rooted", lambda versions: None)
    OE.fold_events(CE.fold_claims(spark, SF))
    assert len(rounds) == 2  # the one slice, and that nothing moves any more


def test_context_is_compared_by_tile_not_by_key(spark, monkeypatch):
    """A claim has dozens of keys that prove a match; a row for each, sorted twice, grew to hours. Large tiles still go by keys, with the same result."""
    claims, events = CE._incoming(spark, SF).localCheckpoint(), CE._stored(spark, SF).localCheckpoint()
    found = lambda same, n=None: sorted(map(tuple, OE.contextual_match(claims, events, same, in_one=n).collect()))
    want = {same: found(same, 0) for same in (True, False)}
    assert all(found(same, 12) == want[same] for same in want) and len(want[True]) > 300
    monkeypatch.setattr(OE, "PART", 20)
    monkeypatch.setattr(OE, "CELLS", 500)
    monkeypatch.setattr(OE, "_match_by_keys", None)
    assert all(found(same) == want[same] for same in want)


def test_sparse_slots_are_compared_by_day(spark):
    """A go of its own for every slot of one or two claims took most of the time; crowded days still go slot by slot, with the same result."""
    claims = X.raw_claims(spark, SF).localCheckpoint()
    found = lambda n=None: sorted(map(tuple, R.burst_counts(claims, n).collect()))
    days = R.burst_counts(claims)
    line = next(x for x in plan_of(days).splitlines() if "FlatMapGroupsInArrow" in x)
    assert "whole" in line and "at_slot" not in line
    assert found() == found(2) == found(6) and any(r[1] for r in found())


def test_rebuild_extracts_claims_once(spark, monkeypatch):
    """Every branch that reads the claims would search the texts again."""
    class Seen(Exception):
        pass

    def seen(raw, *a):
        raise Seen(plan_of(raw))

    monkeypatch.setattr(B, "reuse_payloads", seen)
    msgs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS claim_id", "text", "timestamp_ntz'2024-01-01' AS message_time", "source AS channel", "timestamp_ntz'2024-01-01' AS created_at")
    with pytest.raises(Seen) as plan:
        B.rebuild(msgs, "unused")
    assert "ExistingRDD" in str(plan.value) and "FileScan" not in str(plan.value)


def test_fold_reads_its_slice_batch_by_batch(spark, monkeypatch):
    """A slice of a large table is no group in memory, and no claim becomes a row per key; events beyond those compared one by one are found by key, with the same result."""
    class Seen(Exception):
        pass

    def seen(work, *a):
        raise Seen(work.toArrow())

    cuts, cut = [], FO.cut_lineage
    monkeypatch.setattr(FO, "cut_lineage", lambda df, *a: (cuts.append(plan_of(df)), cut(df, *a))[1])
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", seen)
    with pytest.raises(Seen) as work:
        OE.fold_events(CE.fold_claims(spark, SF), slice_rows=FO.SHORT + 1)
    assert cuts and not [p for p in cuts if "key" in p.replace("keys", "")]
    batches = work.value.args[0].combine_chunks().to_batches(100)
    taken = []
    told = FO._replay(taken.append(1) or b for b in batches)
    assert next(told).num_rows == 100 and len(taken) == 1
    replay = lambda: [r for b in FO._replay(iter(batches)) for r in b.to_pylist()]
    want = replay()
    assert {r["action"] for r in want} >= {"create", "update", "noop"} and any(r["kind"] == "version" for r in want)
    for n in (0, 2, 10_000):
        monkeypatch.setattr(FO, "RECENT", n)
        assert replay() == want


def test_claim_batch_deals_wide_claims_once(spark, monkeypatch):
    """Canonicalisation fused into one stage has methods too long to be compiled; and what is found for a claim is put together before it meets the wide claim."""
    from wireloom.catalog import plans as CP

    class Seen(Exception):
        pass

    plans, cut = [], B.cut_lineage

    def seen(df, *a):
        plans.append(plan_of(df))
        if "burst_count" in df.columns:
            raise Seen
        return cut(df, *a)

    monkeypatch.setattr(B, "cut_lineage", seen)
    with pytest.raises(Seen):
        CP.claim_batch(spark, SF)
    assert "payload_hash" in plans[0] and "*(" not in plans[0]
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"
    assert re.findall(r"SortMergeJoin.*? \[(\w+)#", plans[-1])[:3] == ["claim_id", "claim_id", "existing_event_id"]

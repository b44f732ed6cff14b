"""The claim batch as a whole: reuse, theme evidence and enrichment candidates against plain readings."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wireloom.functions import vocab as V
from wireloom.operators import enrich, themes
from wireloom.plans.claim_batch import claim_batch
from wireloom.sources import fixture as X
from wireloom.sources.messages import REUSE_KEYS, reuse_payloads

SF = "/root/testdata/sf0.001"
WATCH = themes.Theme("watch", "Watch", energy_markers=("oil",), cadences=("daily",))


@pytest.fixture(scope="module")
def batch(spark):
    raw = X.raw_claims(spark, SF).filter("created_at < timestamp_ntz'2024-01-08'")
    keys = {"text_hash": F.when(F.col("claim_id") % 9 != 0, F.col("summary")), **{k: F.lit("1") for k in REUSE_KEYS[1:]}}
    out = claim_batch(raw.withColumns(keys), reuse_hours=24, registered=[*themes.REGISTRY.all(), WATCH])
    return raw, {name: df.cache() for name, df in out.items()}


def test_payloads_are_those_of_the_first_of_a_run(batch):
    raw, out = batch
    last, root, want = {}, {}, {}
    for r in sorted(raw.collect(), key=lambda r: (r.created_at, r.claim_id)):
        if r.claim_id % 9 == 0:
            continue
        if r.summary in last and r.created_at - last[r.summary][0] <= dt.timedelta(hours=24):
            want[r.claim_id] = (last[r.summary][1], root[r.summary])
        else:
            root[r.summary] = r.claim_id
        last[r.summary] = (r.created_at, r.claim_id)
    assert {r.claim_id: (r.reused_claim_id, r.payload_claim_id) for r in out["reuse"].collect()} == want and want
    mine = {r.claim_id: (r.topic, r.event_time) for r in raw.collect()}
    for r in out["claims"].collect():
        assert (r.topic, r.event_time) == mine[want[r.claim_id][1] if r.claim_id in want else r.claim_id]


def test_every_matching_claim_of_an_event_leaves_evidence(batch):
    _, out = batch
    event = {r.claim_id: r.event_id for r in out["actions"].collect()}
    shape = [w for n, ws in V.ARCHETYPES if n in V.SUPPLY_SHAPE_ARCHETYPES or n == "input_price_shock" for w in ws]
    want = set()
    for r in out["claims"].collect():
        stats = [x for s in r.market_stats or [] for x in (s.label, s.context) if x]
        text = " ".join([r.summary or "", r.source_claimed or "", *(r.keywords or []), *stats]).lower()
        found = any(w in text for w in (*V.SUPPLY_MARKERS, *V.DOWNSTREAM_MARKERS, *shape)) or (r.topic == "commodities" and "price" in text)
        for key, markers in (("energy_to_agri_inputs", V.ENERGY_MARKERS), ("watch", ("oil",))):
            if r.claim_id in event and found and any(w in text for w in markers):
                want.add((key, event[r.claim_id], r.claim_id))
    got = out["theme_evidence"].select("theme_key", "event_id", "claim_id", themes.evidence_id().alias("id")).collect()
    assert {r[:3] for r in got} == want and {k for k, *_ in want} == {"energy_to_agri_inputs", "watch"}
    assert len({r.id for r in got}) == len(got) == len(want)


def test_one_candidate_an_event_by_its_latest_claim(batch):
    _, out = batch
    claims = {r.claim_id: r for r in out["claims"].collect()}
    latest = {}
    for a in out["actions"].collect():
        latest[a.event_id] = max(latest.get(a.event_id, (dt.datetime.min, 0, "")), (claims[a.claim_id].created_at, a.claim_id, a.action))
    got = {r.event_id: r for r in out["enrichment_candidates"].collect()}
    assert {e: r.claim_id for e, r in got.items()} == {e: c for e, (_, c, _) in latest.items()}
    chosen = defaultdict(list)
    for e, r in sorted(got.items(), key=lambda x: (x[1].scored_at, x[0])):
        c, codes = claims[r.claim_id], r.reason_codes
        near = any(r.scored_at - t <= dt.timedelta(hours=3) for t in chosen[r.cluster_key])
        known = latest[e][2] != "create"
        titled = "enrichment:novelty_block_title_entity_overlap" in codes
        marked = bool(set(c.triage_reasons) & set(V.DUPLICATE_MARKERS))
        assert ("enrichment:novelty_block_event_lineage" in codes) == known and ("enrichment:novelty_block_cluster_repeat" in codes) == near
        assert r.selected == (c.route == "deep_enrich" and c.triage_action != "archive" and not (known or marked or titled or near))
        if r.selected:
            chosen[r.cluster_key].append(r.scored_at)


def test_history_blocks_a_cluster(spark):
    t = dt.datetime(2024, 1, 1, 12)
    row = lambda i, hours: (i, "k", t + dt.timedelta(hours=hours), "deep_enrich", "promote", [], None, False)
    schema = "event_id long, cluster_key string, scored_at timestamp_ntz, route string, triage_action string, triage_reasons array<string>, existing_event_id long, blocked boolean"
    df = spark.createDataFrame([row(1, 1), row(2, 4), row(3, 5)], schema)
    old = spark.createDataFrame([(90, "k", t, True), (1, "k", t, True), (91, "k", t + dt.timedelta(hours=3), False)], "event_id long, cluster_key string, scored_at timestamp_ntz, selected boolean")
    pick = lambda history: {r.event_id for r in enrich.select_enrichment(df, history).collect() if r.selected}
    assert pick(None) == {1, 3} and pick(old) == {2} and pick(old.limit(0)) == {1, 3}


def test_reuse_of_nulls_ties_and_a_hot_text(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=i // 2), "hot", f"p{i}") for i in range(400)] + [(1000, t, None, "null"), (1001, t, None, "null too"), (1002, t + dt.timedelta(days=2), "hot", "late")]
    df = spark.createDataFrame(rows, "claim_id long, created_at timestamp_ntz, text_hash string, summary string").withColumns({k: F.lit("1") for k in REUSE_KEYS[1:]})
    got = {r.claim_id: (r.reused_claim_id, r.payload_claim_id, r.summary) for r in reuse_payloads(df, ["summary"], 6).collect()}
    assert got == {i: (i - 1 if i else None, 0, "p0") for i in range(400)} | {1000: (None, 1000, "null"), 1001: (None, 1001, "null too"), 1002: (None, 1002, "late")}
    assert reuse_payloads(df.limit(0), ["summary"]).collect() == []

"""Order-dependent operators against plain loops, and boundary cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wireloom.catalog import events as CE
from wireloom.operators import digest as D, enrich as N, events as E, filters as P, search as Q
from wireloom.operators.graph import components
from wireloom.sources import messages as M

SF = "/root/testdata/sf0.001"
H = 3_600_000_000


def plain_fold(rows):
    """One list, one claim at a time: the reading of the fold rules the block job must agree with."""
    events, actions = [], {}
    for r in sorted(rows, key=lambda r: (r["us"], r["claim_id"])):
        fp, found = r["identity"], None
        keys = set(r["keys"])
        if fp:
            same = [e for e in events if e["identity"] == fp]
            found = max(same, key=lambda e: e["last"]) if same else None
        if found is None and (not fp or fp.startswith("v2:")) and r["t"] is not None:
            near = [e for e in events if e["t"] is not None and abs(e["t"] - r["t"]) <= r["w"] and e["keys"] & keys]
            pool = [e for e in near if e["topic"] == r["topic"]] or (near if fp else [])
            found = max(pool, key=lambda e: (e["last"], e["id"])) if pool else None
        if found is None:
            events.append({"id": r["claim_id"], "identity": fp or f"soft:{r['claim_id']}", "topic": r["topic"], "t": r["t"] if r["t"] is not None else r["us"], "last": r["us"],
                           "claim": r["claim"], "payload": r["payload"], "act": r["act"], "bucket": r["bucket"], "keys": keys})
            actions[r["claim_id"]] = (r["claim_id"], "create")
            continue
        act = "update"
        if fp and found["identity"] == fp:
            gap = "unknown" not in (found["bucket"], r["bucket"]) and abs((dt.date.fromisoformat(found["bucket"]) - dt.date.fromisoformat(r["bucket"])).days) > 1
            if found["claim"] == r["claim"]:
                act = "noop"
            elif found["act"] != r["act"] or gap:
                act = "update_conflict"
        found["keys"] = keys
        if act == "update" and found["payload"] != r["payload"]:
            found.update(topic=r["topic"], t=r["t"], last=r["us"], claim=r["claim"], payload=r["payload"], act=r["act"], bucket=r["bucket"])
        actions[r["claim_id"]] = (found["id"], act)
    return actions


def test_fold_equals_plain_list(spark):
    c = CE.fold_claims(spark, SF)
    k = c.select("claim_id", "identity", "topic", E.micros("created_at").alias("us"), E.micros("event_time").alias("t"), E.match_window(F.col("topic"), F.col("is_breaking")).alias("w"),
                 F.coalesce("claim_hash", F.lit("")).alias("claim"), F.col("payload_hash").alias("payload"), F.col("action_class").alias("act"), F.col("time_bucket").alias("bucket"),
                 E.context_keys(F.col("ents"), F.col("words"), F.col("src")).alias("keys"))
    want = plain_fold([r.asDict() for r in k.collect()])
    assert {a for _, a in want.values()} >= {"create", "update", "noop"}
    whole = {r["claim_id"]: (r["event_id"], r["action"]) for r in E.fold_events(c)[1].collect()}
    assert whole == want
    sliced = {r["claim_id"]: (r["event_id"], r["action"]) for r in E.fold_events(c, slice_rows=40)[1].collect()}
    assert sliced == want


def test_components_chain_and_hot_key(spark):
    edges = [(i, f"k{i}") for i in range(200)] + [(i + 1, f"k{i}") for i in range(199)] + [(1000 + i, "hot") for i in range(500)] + [(5000, "alone")]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "node long, key string")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[1000 + i] == 1000 for i in range(500)) and got[5000] == 5000


def test_greedy_selection_equals_loop(spark):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(i, f"k{rng.randrange(4)}", t0 + dt.timedelta(minutes=rng.randrange(6000)), rng.random() < 0.7) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, cluster_key string, scored_at timestamp_ntz, ok boolean").withColumns({
        "route": F.when(F.col("ok"), "deep_enrich").otherwise("index_only"), "triage_action": F.lit("monitor"), "triage_reasons": F.array().cast("array<string>"),
        "existing_event_id": F.lit(None).cast("long"), "blocked": F.lit(False)})
    got = {r["event_id"] for r in N.select_enrichment(df).filter("selected").collect()}
    want, last = set(), {}
    for i, k, t, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = k in last and last[k] >= t - dt.timedelta(hours=3)
        if ok and not hit:
            want.add(i)
            last[k] = t
    assert got == want and 0 < len(want) < len(rows)


def test_stream_novelty_equals_batch(spark):
    from wireloom.catalog import stream
    from wireloom.sources import fixture as X

    got = {r["event_id"] for r in stream.stream_novelty(spark, SF).filter("selected").collect()}
    c = X.claims(spark, SF).select("claim_id", "fingerprint", "created_at", F.coalesce(F.col("impact_score") >= 40, F.lit(False)).alias("ok")).collect()
    want, last = set(), {}
    for r in sorted(c, key=lambda r: (r["created_at"], r["claim_id"])):
        hit = r["fingerprint"] in last and last[r["fingerprint"]] >= r["created_at"] - dt.timedelta(hours=3)
        if r["ok"] and not hit:
            want.add(r["claim_id"])
            last[r["fingerprint"]] = r["created_at"]
    assert got == want


def test_half_open_window_and_digest_merge(spark):
    s = dt.datetime(2024, 1, 1, 4)
    at = [s - dt.timedelta(seconds=1), s, s + dt.timedelta(hours=1), s + dt.timedelta(hours=1), s + dt.timedelta(hours=4)]
    rows = [(i, "fx", f"Summary {i % 2}.", 50.0, t, None, "h1" if i in (2, 3) else None, False) for i, t in enumerate(at)]
    ev = spark.createDataFrame(rows, "event_id long, topic string, summary string, impact_score double, last_updated_at timestamp_ntz, fingerprint string, claim_hash string, is_published boolean")
    kept = P.in_window(ev, "last_updated_at", F.lit(at[1]), F.lit(at[4]))
    assert sorted(r["event_id"] for r in kept.collect()) == [1, 2, 3]
    layout = D.digest_windows(ev).filter(F.col("window_start") == F.lit(s)).collect()
    # 1 and 3 share a summary, 2 and 3 a claim: one bullet with three events
    assert [(r["section"], r["representative_id"], r["n_events"]) for r in layout] == [("top", 2, 3)]


def test_eligible_messages(spark):
    now = dt.datetime(2024, 1, 1, 12)
    raw = spark.createDataFrame([(i, now - dt.timedelta(minutes=10 - i)) for i in range(1, 5)], "raw_message_id long, message_timestamp_utc timestamp_ntz")
    st = spark.createDataFrame([(1, "pending", None), (2, "failed", None), (3, "in_progress", now - dt.timedelta(minutes=1)), (4, "in_progress", now + dt.timedelta(minutes=5))],
                               "raw_message_id long, status string, lease_expires_at timestamp_ntz")
    assert [r["raw_message_id"] for r in M.eligible(raw, st, F.lit(now), 10).collect()] == [3, 2, 1]


def test_ingest_is_idempotent_under_order_and_partitions(spark):
    rows = [(i, f"s{i % 3}", str(i % 7), f"t{i}") for i in range(100)]
    schema = "arrival_id long, source_stream_id string, source_message_id string, raw_text string"
    none = spark.createDataFrame([], schema)
    base = {r["arrival_id"] for r in M.ingest(spark.createDataFrame(rows, schema), none)[0].collect()}
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    again = {r["arrival_id"] for r in M.ingest(spark.createDataFrame(shuffled, schema).repartition(13), none)[0].collect()}
    assert base == again == set(range(21))
    stored = spark.createDataFrame(rows, schema)
    assert M.ingest(stored, stored)[0].count() == 0


def test_pages_cover_the_feed_once(spark):
    from wireloom.sources import fixture as X

    ev = X.events(spark, SF).cache()
    items, pages = Q.feed_pages(ev, 20)
    ids = [r["event_id"] for r in items.collect()]
    assert len(ids) == len(set(ids)) == P.feed_rows(ev).count()
    walk, key = [], None
    for _ in range(3):
        page = Q.feed_page(ev, 20, key).collect()
        walk += [r["event_id"] for r in page]
        key = (F.lit(page[0]["next_time"]), page[0]["next_id"])
    assert walk == [r["event_id"] for r in items.filter("position <= 60").orderBy("position").collect()]
    assert sum(r["n_items"] for r in pages.collect()) == len(ids)


def test_duplicate_search_equals_plain_scan(spark):
    from difflib import SequenceMatcher

    from wireloom.catalog.search import _dup_input

    ev = _dup_input(spark, SF).filter("topic IN ('fx', 'rates')")
    rows = [r.asDict() for r in ev.collect()]
    got = {}
    for r in Q.duplicate_candidates(ev, scan=40).collect():
        got.setdefault(r["event_id"], []).append((r["position"], r["candidate_id"], r["score"]))
    for b in rows:
        pool = sorted((r for r in rows if r["topic"] == b["topic"] and r["event_id"] != b["event_id"]), key=lambda r: (r["last_updated_at"], r["event_id"]), reverse=True)[:40]
        out = []
        for c in pool:
            ratio = SequenceMatcher(a=b["summary"].lower(), b=c["summary"].lower()).ratio()
            hours = abs((c["event_time"] - b["event_time"]).total_seconds()) / 3600 if b["event_time"] and c["event_time"] else None
            score = 8 * (b["identity"] == c["identity"]) + 5 * bool(b["claim_hash"] and b["claim_hash"] == c["claim_hash"]) + 4 * (b["payload_hash"] == c["payload_hash"])
            score += 2 if ratio >= 0.9 else 1 if ratio >= 0.8 else 0
            score += min(2, len(set(b["entities"]) & set(c["entities"]))) + (len(set(b["words"]) & set(c["words"])) >= 2)
            score += hours is not None and hours <= (6 if b["is_breaking"] else 24)
            if score >= 3:
                out.append((-score, hours if hours is not None else 9999.0, c["event_id"]))
        want = [(i + 1, e, -s) for i, (s, _, e) in enumerate(sorted(out)[:20])]
        assert sorted(got.get(b["event_id"], [])) == want


def test_duplicates_of_events_without_topic(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(i, t, f"text {i}", at(i), False, f"id{i}", h, f"p{i}", ["a", "b"] if i in (1, 2, 5) else [], [], at(i)) for i, (t, h) in enumerate(
        [("fx", "h1"), ("fx", "h1"), ("rates", "h1"), (None, "h2"), ("fx", "h2"), (None, "h1"), (" ", "h3")])]
    ev = spark.createDataFrame(rows, "event_id long, topic string, summary string, event_time timestamp_ntz, is_breaking boolean, identity string, claim_hash string, payload_hash string, "
                               "entities array<string>, words array<string>, last_updated_at timestamp_ntz")
    got = {}
    for r in Q.duplicate_candidates(ev, scan=6, with_ratio=False).collect():
        got.setdefault(r["event_id"], []).append(r["candidate_id"])
    # with a topic: others of the topic; without: the latest of all
    assert got == {0: [1], 1: [0], 3: [4], 5: [2, 1, 0]}
    few = {r["candidate_id"] for r in Q.duplicate_candidates(ev, scan=3, with_ratio=False).filter("event_id = 5").collect()}
    assert few == set()


def test_band_joins_have_no_nested_loops(spark):
    from wireloom import catalog

    catalog.load()
    for name in ("recent_related", "reusable_claims", "title_entity_overlap", "contextual_match", "cluster_repeat"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

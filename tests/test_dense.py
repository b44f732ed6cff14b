"""Work on dense input grows with the rows, not with the pairs of a group."""

from pyspark.sql import functions as F

from wireloom.functions import vocab as V
from wireloom.operators import digest as D, quality as Q, triage as R


def _burst(spark, n):
    """Claims of one topic and quarter of an hour, all of one fingerprint, in many profiles."""
    i = F.col("id")
    pick = lambda k, name: F.concat(F.lit(name), (i % k).cast("string"))
    some = lambda *items: F.array_compact(F.array(*items))
    return spark.range(n).select(
        i.alias("claim_id"), F.lit("fx").alias("topic"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + (i * 7919 % 1700) * 1_000_000).cast("timestamp_ntz").alias("created_at"),
        F.when(i % 11 != 0, pick(2, "f")).alias("fingerprint"), pick(3, "s").alias("source_claimed"), (i * 37 % 100).cast("double").alias("impact_score"),
        some(pick(5, "c"), F.when(i % 4 == 0, "us")).alias("countries"), some(F.when(i % 7 != 0, pick(3, "o"))).alias("orgs"),
        some(F.when(i % 13 == 0, "p")).alias("people"), F.array(pick(4, "w"), pick(9, "v"), pick(2, "u"), F.concat(F.lit("x"), i.cast("string"))).alias("keywords"))


def test_burst_stores_no_pairs(spark, monkeypatch):
    n, stored, cut = 400, [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df, *a: (lambda out: (stored.append(out.count()), out)[1])(cut(df, *a)))
    assert R.burst_counts(_burst(spark, n)).count() == n
    assert max(stored) <= 2 * n


def test_burst_by_profile_is_the_direct_comparison(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    claims = _burst(spark, 400)
    direct = rows(R.burst_counts(claims))
    assert direct == rows(R.burst_counts(claims, in_one=1)) == rows(R.burst_counts(claims, in_one=300))
    assert len({r[2] for r in direct}) > 20 and {r[1] for r in direct} == {True, False}


def test_digest_search_runs_over_anchors(spark, monkeypatch):
    """Events of one fingerprint are one cluster before the search starts; only a few of them are tied to another by hash or summary."""
    n, nodes, search = 300, [], D.components
    monkeypatch.setattr(D, "components", lambda edges: (nodes.append(edges.select("node").distinct().count()), search(edges))[1])
    i = F.col("id")
    source = spark.range(n).select(
        i.alias("event_id"), F.lit(1).alias("window_start"), F.lit(2).alias("window_end"), (i % 2).cast("string").alias("topic_label"),
        F.when(i % 50 > 1, F.concat(F.lit("F"), (i % 10).cast("string"))).alias("fingerprint"), F.when(i % 50 != 0, F.concat(F.lit("h"), (i % 97).cast("string"))).alias("claim_hash"),
        F.when(i % 100 != 0, F.concat(F.lit("s"), i.cast("string"))).otherwise("").alias("summary_key"), F.lit("x").alias("summary"), (i % 7).cast("double").alias("impact_score"),
        F.timestamp_micros(i * 60_000_000).cast("timestamp_ntz").alias("last_updated_at"))
    clusters = D.digest_clusters(source)
    assert max(nodes) < n / 10
    rows = source.collect()
    best = {r.event_id: r.event_id for r in rows}
    for _ in range(n):
        low = {}
        keys = lambda r: [(r.topic_label, k, v.lower()) for k, v in (("c", r.claim_hash), ("f", r.fingerprint), ("s", r.summary_key)) if v]
        for r in rows:
            for k in keys(r):
                low[k] = min(low.get(k, n), best[r.event_id])
        new = {r.event_id: min([best[r.event_id], *(low[k] for k in keys(r))]) for r in rows}
        if new == best:
            break
        best = new
    assert {r.event_id: r.cluster_id for r in clusters.collect()} == best and len(set(best.values())) > 2
    table = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert table(D.digest_groups(source)) == table(D.merge_clusters(clusters))


def test_traceability_deals_references_by_the_number_of_memos(spark, monkeypatch):
    """References pack well, so partitions cut by packed bytes hold ever more of them; none is sorted twice."""
    monkeypatch.setattr(Q, "MEMOS", 20)
    i, none = F.col("id"), F.array().cast("array<string>")
    memos = spark.range(400).select(i.alias("memo_id"), *[none.alias(n) for n in V.MEMO_LIST_SECTIONS])
    keys = Q.required_paragraphs(memos)
    m, wanted = F.col("memo_id"), set(V.MEMO_TRACED_SECTIONS)
    refs = keys.select("memo_id", "paragraph_key", F.when(m % 5 != 0, m + F.when(m % 7 == 0, 1).otherwise(0)).alias("event_id"), F.lit(None).cast("string").alias("source_id")).unionByName(
        keys.select("memo_id", "paragraph_key", F.lit(None).cast("long").alias("event_id"), F.when(m % 11 == 0, "s9").otherwise("s1").alias("source_id")))
    out = Q.audit_traceability(memos, refs, memos.select("memo_id", m.alias("event_id")), memos.select("memo_id", F.lit("s1").alias("source_id")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(memo_id" in plan
    got = {tuple(r) for r in out.collect()}
    want = set()
    for k in range(400):
        codes = ["missing_traceability"] if k % 5 == 0 else ["invalid_traceability_internal_event_id"] * (k % 7 == 0) + ["invalid_traceability_external_source_id"] * (k % 11 == 0)
        want |= {(k, c, p) for c in codes for p in wanted}
    assert got == want

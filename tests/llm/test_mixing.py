"""Raked weights against a plain loop, sampling probabilities and their marginals."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wireloom.llm.mixing import BUDGET, MARGINS, TARGETS, mix, rake, tokens_of, topic_of


def plain(rows):
    """rows: (source, lang, topic, tokens) per document. Cell -> (tokens, raked weight)."""
    cells = defaultdict(float)
    for *key, n in rows:
        cells[tuple(key)] += n
    total, weight = sum(cells.values()), dict(cells)
    targets = []
    for d, name in enumerate(MARGINS):
        share = defaultdict(float)
        for k, n in cells.items():
            share[k[d]] += n / total
        rule = TARGETS[name]
        raw = {v: (rule.get(v, s) if isinstance(rule, dict) else s ** rule) for v, s in share.items()}
        targets.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(200):
        for d in range(3):
            have = defaultdict(float)
            for k, w in weight.items():
                have[k[d]] += w
            weight = {k: w * targets[d][k[d]] * total / have[k[d]] for k, w in weight.items()}
    return cells, weight


def test_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    got = mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sample_weight", "sampled").collect()
    cells, weight = plain([(r.source, r.lang, r.topic, r.n_tokens) for r in got])
    total = sum(cells.values())
    for r in got:
        k = r.source, r.lang, r.topic
        r0 = got[0]
        base = weight[k] / cells[k] / (weight[r0.source, r0.lang, r0.topic] / cells[r0.source, r0.lang, r0.topic])
        assert abs(r.probability * r.sample_weight / (r0.probability * r0.sample_weight) / base - 1) < 1e-3
        assert 0 < r.probability <= 1 and r.sample_weight >= 1
    assert abs(sum(r.n_tokens * r.probability for r in got) / total - BUDGET) < 1e-6
    kept = sum(r.n_tokens for r in got if r.sampled)
    assert abs(kept / total - BUDGET) < 0.03
    en = sum(r.n_tokens * r.sample_weight for r in got if r.sampled and r.lang == "en") / sum(r.n_tokens * r.sample_weight for r in got if r.sampled)
    assert abs(en - 0.55) < 0.03


def test_edges(spark):
    rows = [(1, "a", "s", "en"), (1, "a", "s", "en"), (2, None, None, None), (3, "", "s", "xx"), (None, "b", "t", "de"), (4, "x" * 2_000_000, "t", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("topic", F.lit("clash")).withColumn("weight", F.lit(1)).withColumn("draw", F.lit(2))
    got = mix(docs).collect()
    assert len(got) == len(rows) and {r.topic for r in got} == {"prose"} and all(r.weight == 1 and r.draw == 2 for r in got)
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1
    assert all(r.sampled for r in mix(docs, budget=1.0, targets={}).collect())
    assert mix(docs.limit(0)).collect() == []


def test_pipeline_stage_meets_targets_unweighted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    before, after = ([tuple(r) for r in d.select("source", "lang", topic_of(F.col("text")), tokens_of(F.coalesce("text", F.lit("")))).collect()] for d in (docs, corpus_pipeline.sample_mix(spark, docs, None)))
    _, weight = plain(before)
    total, kept = sum(weight.values()), sum(r[3] for r in after)
    for d in range(3):
        want, have = defaultdict(float), defaultdict(float)
        for k, w in weight.items():
            want[k[d]] += w / total
        for *k, n in after:
            have[k[d]] += n / kept
        assert all(abs(have[v] - want[v]) < 0.01 for v in want)


def test_unmet_marginals_are_reported(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off its target"):
        rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}).collect()

"""Digest queries: one row set per four-hour window of the whole claim view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, case_map, with_
from ..functions import vocab as V
from ..operators import digest as D
from ..session import cut_lineage
from ..sources import fixture as X

SOURCE = f"""src AS (SELECT claim_id AS event_id, topic, {case_map('topic', V.TOPIC_LABELS, 'topic')} AS topic_label, summary, impact_score, last_updated_at, fingerprint, claim_hash,
    time_bucket(INTERVAL '4' HOUR, last_updated_at) AS window_start, time_bucket(INTERVAL '4' HOUR, last_updated_at) + INTERVAL '4' HOUR AS window_end,
    trim(regexp_replace(lower(summary), '[^\\w\\s]', '', 'g')) AS summary_key
  FROM claims WHERE impact_score > 35 AND coalesce(is_published, false) = false)"""
CLUSTERS = """edges AS (SELECT window_start, topic_label, event_id, 'c' || lower(claim_hash) AS k FROM src WHERE claim_hash IS NOT NULL
  UNION ALL SELECT window_start, topic_label, event_id, 'f' || lower(fingerprint) FROM src UNION ALL SELECT window_start, topic_label, event_id, 's' || summary_key FROM src),
pairs AS (SELECT DISTINCT a.event_id AS a, b.event_id AS b FROM edges a JOIN edges b USING (window_start, topic_label, k)),
reach AS (SELECT event_id AS a, event_id AS b FROM src UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
clus AS (SELECT s.*, cluster_id FROM src s JOIN (SELECT a AS event_id, min(b) AS cluster_id FROM reach GROUP BY 1) USING (event_id))"""
GROUPS = """grp AS (SELECT c.window_start, c.window_end, c.topic_label, c.cluster_id, rep.event_id AS representative_id, rep.summary, c.impact_score, c.last_updated_at,
    coalesce(rep.fingerprint, f) AS fingerprint, coalesce(rep.claim_hash, h) AS claim_hash, n_events FROM (
  SELECT window_start, window_end, topic_label, cluster_id, max(impact_score) AS impact_score, max(last_updated_at) AS last_updated_at, count(*) AS n_events,
    arg_min(fingerprint, event_id) AS f, arg_min(claim_hash, event_id) FILTER (claim_hash IS NOT NULL) AS h FROM clus GROUP BY ALL) c
  JOIN (SELECT * FROM clus QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(impact_score, -1) DESC, last_updated_at DESC, event_id) = 1) rep USING (cluster_id))"""
_ORD = "coalesce(impact_score, -1) DESC, last_updated_at DESC, representative_id"
LAYOUT = f"""heads AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY {_ORD}) AS position FROM grp QUALIFY position <= 3),
layout AS (SELECT window_start, window_end, 'top' AS section, position, topic_label, representative_id, summary, impact_score, n_events FROM heads
  UNION ALL SELECT window_start, window_end, topic_label, position, topic_label, representative_id, summary, impact_score, n_events FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start, topic_label ORDER BY {_ORD}) AS position FROM grp
    WHERE representative_id NOT IN (SELECT representative_id FROM heads)) r WHERE position <= 6)"""
CTES = (CLAIMS, SOURCE, CLUSTERS, GROUPS, LAYOUT)


def source(spark, sf):
    return D.windowed_source(X.claims(spark, sf).withColumnRenamed("claim_id", "event_id"))


@register("digest_source", with_(CLAIMS, SOURCE) + "SELECT event_id, topic_label, summary, summary_key, window_start, window_end FROM src")
def digest_source(spark, sf):
    return source(spark, sf).select("event_id", "topic_label", "summary", "summary_key", "window_start", "window_end")


@register("digest_clusters", with_(*CTES[:3]) + "SELECT event_id, cluster_id FROM clus")
def digest_clusters(spark, sf):
    return D.digest_clusters(source(spark, sf)).select("event_id", "cluster_id")


@register("digest_groups", with_(*CTES[:4]) + "SELECT * FROM grp")
def digest_groups(spark, sf):
    return D.digest_groups(source(spark, sf))


@register("digest_layout", with_(*CTES) + "SELECT * FROM layout")
def digest_layout(spark, sf):
    return D.digest_windows(X.claims(spark, sf).withColumnRenamed("claim_id", "event_id"))


@register("digest_coverage", with_(*CTES) + """SELECT window_start, window_end, section, sum(n_events)::BIGINT AS covered_events, count(*) AS n_bullets FROM (
  SELECT * FROM layout UNION ALL SELECT * REPLACE ('*' AS section) FROM layout) GROUP BY ALL""")
def digest_coverage(spark, sf):
    return D.digest_coverage(digest_layout(spark, sf))


@register("digest_text", with_(*CTES) + """, sec AS (SELECT window_start, window_end, section, string_agg('- ' || summary, chr(10) ORDER BY position) AS body, sum(n_events)::BIGINT AS n, count(*) AS k FROM layout GROUP BY ALL),
win AS (SELECT window_start, window_end, string_agg('== ' || CASE WHEN section = 'top' THEN 'Top developments' ELSE section END || ' ==' || chr(10) || body, chr(10) || chr(10) ORDER BY section <> 'top', lower(section)) AS body,
  string_agg(section || ': ' || n, ', ' ORDER BY lower(section)) FILTER (section <> 'top') AS counts, sum(n)::BIGINT AS covered, sum(CASE WHEN section = 'top' THEN k ELSE 0 END)::BIGINT AS tops FROM sec GROUP BY ALL)
SELECT window_start, window_end, 'Window ' || strftime(window_start, '%Y-%m-%d %H:%M:%S UTC') || ' to ' || strftime(window_end, '%Y-%m-%d %H:%M:%S UTC') || chr(10) || 'Covered events: ' || covered || chr(10)
  || 'Source events: ' || n_source || chr(10) || 'Top developments: ' || tops || chr(10) || 'Counts: ' || coalesce(counts, '0') || chr(10) || chr(10) || body || chr(10) AS canonical_text, sha256(canonical_text) AS canonical_hash
FROM win JOIN (SELECT window_start, count(*) AS n_source FROM src GROUP BY 1) USING (window_start)""".replace(")\n, sec", "),\nsec"))
def digest_text(spark, sf):
    return D.digest_text(digest_layout(spark, sf), source(spark, sf))


_WORD = lambda k: f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT"


@register("digest_input_hash", with_(CLAIMS, SOURCE) + f"""SELECT window_start, window_end, n, sha256(concat_ws('|', '3/6', 'v1', strftime(window_start, '%Y-%m-%d %H:%M:%S'), strftime(window_end, '%Y-%m-%d %H:%M:%S'), n, s0, s1, s2, s3, x0, x1, x2, x3)) AS input_hash
FROM (SELECT window_start, window_end, count(*) AS n, {', '.join(f'sum({_WORD(k)})::BIGINT AS s{k}' for k in range(4))}, {', '.join(f'bit_xor({_WORD(k)}) AS x{k}' for k in range(4))}
  FROM (SELECT *, sha256(concat_ws('|', event_id, topic_label, summary, coalesce(fingerprint, '~'), coalesce(claim_hash, '~'), epoch_us(last_updated_at), coalesce(topic, '~'), coalesce(round(impact_score * 1000000)::BIGINT::VARCHAR, '~'))) AS h FROM src) a GROUP BY window_start, window_end) b""")
def digest_input_hash(spark, sf):
    return D.input_hash(source(spark, sf), "3/6")


COVERED = """, told AS (SELECT y.window_start, y.window_end, y.section, y.position, y.representative_id, m.event_id FROM layout y JOIN clus r ON r.event_id = y.representative_id JOIN clus m ON m.cluster_id = r.cluster_id AND m.window_start = r.window_start)
"""


def clusters_and_layout(spark, sf):
    clusters = cut_lineage(D.digest_clusters(source(spark, sf)))
    return clusters, D.digest_layout(D.merge_clusters(clusters))


@register("digest_covered_events", with_(*CTES).rstrip("\n") + COVERED + "SELECT * FROM told")
def digest_covered_events(spark, sf):
    return D.covered_events(*clusters_and_layout(spark, sf))


@register("digest_marked_events", with_(*CTES).rstrip("\n") + COVERED + """SELECT claim_id AS event_id, coalesce(is_published, false) OR claim_id IN (SELECT event_id FROM told) AS is_published FROM claims""")
def digest_marked_events(spark, sf):
    """Publication flags after every window's digest has been published."""
    events = X.claims(spark, sf).withColumnRenamed("claim_id", "event_id")
    return D.mark_published(events, D.covered_events(*clusters_and_layout(spark, sf)), "vip_telegram").select("event_id", "is_published")

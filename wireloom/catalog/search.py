"""Search, feed, lineage and inspection queries over the event view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CANDIDATES, CLAIMS, EVENTS, EVENT_RELATIONS, EVENT_TAGS, LINKS, with_
from ..functions import text as T
from ..operators import search as Q
from ..operators.filters import ts
from ..sources import fixture as X

S0, S1 = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
_IN = f"event_time BETWEEN TIMESTAMP '{S0}' AND TIMESTAMP '{S1}'"
_RANK = "impact_score DESC NULLS LAST, event_time DESC NULLS LAST, event_id DESC"
_EV = (CLAIMS, EVENTS)


@register("events_by_tag", with_(*_EV, EVENT_TAGS) + f"""SELECT event_id, impact_score FROM evs e WHERE {_IN} AND impact_score >= 20
  AND event_id IN (SELECT event_id FROM tags WHERE tag_type = 'commodities' AND lower(tag_value) = 'oil')
  AND event_id IN (SELECT event_id FROM tags WHERE tag_type = 'directionality' AND tag_value = 'stress') ORDER BY {_RANK} LIMIT 40""")
def events_by_tag(spark, sf):
    ev = X.events(spark, sf)
    return Q.events_by_tag(ev, X.event_tags(ev), "Commodity", " OIL ", ts(S0), ts(S1), 20.0, "stress", 40).select("event_id", "impact_score")


@register("events_by_relation", with_(*_EV, EVENT_TAGS, EVENT_RELATIONS) + f"""SELECT event_id, impact_score FROM evs e WHERE {_IN}
  AND event_id IN (SELECT event_id FROM rels WHERE relation_type = 'supports' AND subject_type = 'country' AND lower(subject_value) = 'iran') ORDER BY {_RANK} LIMIT 60""")
def events_by_relation(spark, sf):
    ev = X.events(spark, sf)
    return Q.events_by_relation(ev, X.event_relations(ev), "supports", ts(S0), ts(S1), subject_type="country", subject_value="IRAN", limit=60).select("event_id", "impact_score")


@register("with_facets", with_(*_EV, EVENT_TAGS, CANDIDATES) + """SELECT e.event_id, t.tag_value AS directionality, c.route AS enrichment_route FROM evs e
  LEFT JOIN tags t ON t.event_id = e.event_id AND t.tag_type = 'directionality' LEFT JOIN cands c ON c.event_id = e.event_id""")
def with_facets(spark, sf):
    ev = X.events(spark, sf)
    return Q.with_facets(ev, X.event_tags(ev), X.candidates(ev)).select("event_id", "directionality", "enrichment_route")


@register("event_detail", with_(*_EV, LINKS) + """SELECT e.event_id, c.topic AS claim_topic, c.claim_hash AS latest_claim_hash, n AS message_count FROM evs e
  LEFT JOIN claims c ON c.claim_id = e.latest_claim_id LEFT JOIN (SELECT event_id, count(*) AS n FROM links GROUP BY 1) l ON l.event_id = e.event_id""")
def event_detail(spark, sf):
    return Q.event_detail(X.events(spark, sf), X.claims(spark, sf), X.links(spark, sf))[0].select("event_id", "claim_topic", "latest_claim_hash", "message_count")


@register("event_messages", with_(*_EV, LINKS) + "SELECT event_id, raw_message_id, row_number() OVER (PARTITION BY event_id ORDER BY linked_at, raw_message_id) AS position FROM links")
def event_messages(spark, sf):
    return Q.event_detail(X.events(spark, sf), X.claims(spark, sf), X.links(spark, sf))[1]


def _raw(c):
    return c.select(F.col("claim_id").alias("raw_message_id"), F.col("source_claimed").alias("channel"))


def _claim(c):
    return c.select(F.col("claim_id").alias("raw_message_id"), F.col("topic").alias("claim_topic"), F.col("impact_score").alias("claim_impact"))


def _routing(c):
    return c.filter("confidence >= 0.3").select(F.col("claim_id").alias("raw_message_id"), F.when(F.col("impact_score") >= 60, "promote").otherwise("monitor").alias("triage_action"))


_ROUTING = "routing AS (SELECT claim_id AS raw_message_id, CASE WHEN impact_score >= 60 THEN 'promote' ELSE 'monitor' END AS triage_action FROM claims WHERE confidence >= 0.3)"


_LONG_LINKS = "long_links AS (SELECT min(claim_id) OVER (PARTITION BY fingerprint) AS event_id, claim_id AS raw_message_id, created_at AS linked_at FROM claims)"


@register("event_lineage", with_(*_EV, _LONG_LINKS, _ROUTING) + """SELECT event_id, raw_message_id, channel, claim_topic, triage_action, total, total > 100 AS truncated, position FROM (
  SELECT l.*, source_claimed AS channel, topic AS claim_topic, triage_action, count(*) OVER (PARTITION BY event_id) AS total,
    row_number() OVER (PARTITION BY event_id ORDER BY linked_at, l.raw_message_id) AS position
  FROM long_links l JOIN claims c ON c.claim_id = l.raw_message_id LEFT JOIN routing r ON r.raw_message_id = l.raw_message_id) WHERE position <= 100""")
def event_lineage(spark, sf):
    c = X.claims(spark, sf)
    first = c.groupBy("fingerprint").agg(F.min("claim_id").alias("event_id"))  # one event per fingerprint: lists beyond the cap
    links = c.select("fingerprint", F.col("claim_id").alias("raw_message_id"), F.col("created_at").alias("linked_at")).join(first, "fingerprint").drop("fingerprint")
    return Q.event_lineage(links, _raw(c), _claim(c), _routing(c)).select(
        "event_id", "raw_message_id", "channel", "claim_topic", "triage_action", "total", "truncated", "position")


@register("message_context", with_(*_EV, LINKS, _ROUTING) + """SELECT c.claim_id AS raw_message_id, c.topic AS claim_topic, triage_action, l.event_id, e.summary AS event_summary FROM claims c
  LEFT JOIN routing r ON r.raw_message_id = c.claim_id LEFT JOIN links l ON l.raw_message_id = c.claim_id LEFT JOIN evs e ON e.event_id = l.event_id""")
def message_context(spark, sf):
    c = X.claims(spark, sf)
    ev = X.events(spark, sf).select("event_id", F.col("summary").alias("event_summary"))
    return Q.message_context(_raw(c), _claim(c), _routing(c), X.links(spark, sf), ev).select("raw_message_id", "claim_topic", "triage_action", "event_id", "event_summary")


@register("pipeline_overview", with_(*_EV, LINKS, _ROUTING) + """SELECT c.claim_id AS raw_message_id, CASE WHEN is_breaking THEN 'completed' END AS status, topic AS claim_topic, triage_action, event_id FROM claims c
  LEFT JOIN routing r ON r.raw_message_id = c.claim_id LEFT JOIN links l ON l.raw_message_id = c.claim_id ORDER BY c.claim_id DESC, event_id DESC LIMIT 25""")
def pipeline_overview(spark, sf):
    c = X.claims(spark, sf)
    state = c.filter("is_breaking").select(F.col("claim_id").alias("raw_message_id"), F.lit("completed").alias("status"))
    return Q.pipeline_overview(_raw(c), state, _claim(c), _routing(c), X.links(spark, sf).select("raw_message_id", "event_id"), 25).select(
        "raw_message_id", "status", "claim_topic", "triage_action", "event_id")


_CMP = ("topic", "event_time", "impact_score", "is_breaking", "breaking_window", "summary", "identity", "claim_hash", "payload_hash", "action_class", "time_bucket")


def _same(c):
    return f"coalesce(abs(c.{c} - e.{c}) <= 0.01, c.{c} IS NULL AND e.{c} IS NULL)" if c == "impact_score" else f"c.{c} IS NOT DISTINCT FROM e.{c}"


@register("compare_claims_to_events", with_(*_EV, LINKS) + f"""SELECT raw_message_id, event_id, array_to_string(m, ',') AS mismatches, CASE WHEN event_id IS NULL THEN 0 ELSE 11 - len(m) END AS match_count,
  len(m) AS mismatch_count, CASE WHEN event_id IS NULL THEN 'no_linked_event' WHEN len(m) = 0 THEN 'consistent' ELSE 'inconsistent' END AS status FROM (
  SELECT c.claim_id AS raw_message_id, l.event_id, CASE WHEN l.event_id IS NULL THEN [] ELSE list_filter([{', '.join(f"CASE WHEN NOT ({_same(c)}) THEN '{c}' END" for c in _CMP)}], lambda v: v IS NOT NULL) END AS m
  FROM (SELECT *, 'p-' || sha256(summary) AS payload_hash, 'other' AS action_class, coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS time_bucket FROM claims) c
  LEFT JOIN (SELECT raw_message_id, CASE WHEN linked_at >= TIMESTAMP '2024-01-03' THEN event_id END AS event_id FROM links) l ON l.raw_message_id = c.claim_id
  LEFT JOIN (SELECT *, CASE WHEN is_breaking THEN 'operational' ELSE 'other' END AS action_class FROM evs) e ON e.event_id = l.event_id)""")
def compare_claims_to_events(spark, sf):
    c = X.claims(spark, sf).withColumns({
        "raw_message_id": F.col("claim_id"), "payload_hash": F.concat(F.lit("p-"), F.sha2("summary", 256)), "action_class": F.lit("other"),
        "time_bucket": F.coalesce(F.date_format("event_time", "yyyy-MM-dd"), F.lit("unknown"))})
    ev = X.events(spark, sf).withColumn("action_class", F.when(F.col("is_breaking"), "operational").otherwise("other"))
    # the links of the first two days name no event yet, so that the third status occurs
    links = X.links(spark, sf).withColumn("event_id", F.when(F.col("linked_at") >= ts("2024-01-03"), F.col("event_id")))
    return Q.compare_claims_to_events(c, links, ev).withColumn("mismatches", F.array_join("mismatches", ","))


@register("order_events", with_(*_EV) + f"SELECT event_id, impact_score FROM evs ORDER BY {_RANK}")
def order_events(spark, sf):
    return Q.order_events(X.events(spark, sf)).select("event_id", "impact_score")


_FEED = "feed AS (SELECT *, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS position FROM evs WHERE event_time IS NOT NULL AND length(trim(summary)) > 0)"


@register("feed_page", with_(*_EV) + f"""SELECT event_id, summary, topic, event_time, impact_score, n > 50 AS has_more, CASE WHEN n > 50 THEN t END AS next_time, CASE WHEN n > 50 THEN i END AS next_id FROM (
  SELECT event_id, trim(summary) AS summary, topic, event_time, round_even(coalesce(impact_score, 0), 0)::BIGINT AS impact_score, p, count(*) OVER () AS n, max(CASE WHEN p = 50 THEN event_time END) OVER () AS t, max(CASE WHEN p = 50 THEN event_id END) OVER () AS i
  FROM (SELECT *, row_number() OVER (ORDER BY event_time DESC, event_id DESC) AS p FROM evs WHERE event_time < TIMESTAMP '{S1}' AND topic = 'credit' QUALIFY p <= 51) a) b WHERE p <= 50""")
def feed_page(spark, sf):
    return Q.feed_page(X.events(spark, sf), 50, (ts(S1), 0), "credit")


@register("feed_items", with_(*_EV, _FEED) + "SELECT event_id, position, (position - 1) // 50 AS page FROM feed")
def feed_items(spark, sf):
    return Q.feed_pages(X.events(spark, sf), 50)[0].select("event_id", "position", "page")


@register("feed_pages", with_(*_EV, _FEED) + """SELECT page, n_items, has_more, CASE WHEN has_more THEN t END AS next_time, CASE WHEN has_more THEN i END AS next_id FROM (
  SELECT (position - 1) // 50 AS page, count(*) AS n_items, max(position) < (SELECT count(*) FROM feed) AS has_more, min(event_time) AS t, arg_max(event_id, position) AS i FROM feed GROUP BY 1)""")
def feed_pages(spark, sf):
    return Q.feed_pages(X.events(spark, sf), 50)[1]


@register("latest_runs", with_(CLAIMS) + "SELECT claim_id AS run_id, created_at FROM claims WHERE topic = 'fx' ORDER BY created_at DESC, claim_id DESC LIMIT 20")
def latest_runs(spark, sf):
    runs = X.claims(spark, sf).select(F.col("claim_id").alias("run_id"), F.col("topic").alias("theme_key"), "created_at")
    return Q.latest_runs(runs, "fx", 20).select("run_id", "created_at")


def _dup_input(spark, sf):
    sig = T.entity_signature(F.array("country"), F.array("org"), F.array().cast("array<string>"))
    return X.events(spark, sf).withColumns({"entities": sig, "words": T.lowered_set(F.split("phrase", " "))})


_DUP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY last_updated_at DESC, event_id DESC) AS rk, string_split(phrase, ' ') AS words FROM evs),
pairs AS (SELECT b.event_id, c.event_id AS candidate_id, abs(epoch_us(b.event_time) - epoch_us(c.event_time)) / 3600000000.0 AS hours_apart,
    b.identity = c.identity AS same_identity, coalesce(b.claim_hash = c.claim_hash, false) AS same_claim, b.payload_hash = c.payload_hash AS same_payload,
    (b.country = c.country)::INT + (lower(b.org) = lower(c.org))::INT AS shared_entities, len(list_intersect(b.words, c.words)) AS shared_words, b.is_breaking
  FROM ranked b JOIN ranked c ON b.topic = c.topic AND c.event_id <> b.event_id AND c.rk <= CASE WHEN b.rk <= 250 THEN 251 ELSE 250 END),
scored AS (SELECT *, 8 * same_identity::INT + 5 * same_claim::INT + 4 * same_payload::INT + shared_entities + (shared_words >= 2)::INT + within::INT AS score
  FROM (SELECT *, coalesce(hours_apart <= CASE WHEN is_breaking THEN 6 ELSE 24 END, false) AS within FROM pairs) p)"""


@register("duplicate_candidates_native", with_(*_EV, _DUP) + """SELECT event_id, candidate_id, score::BIGINT AS score, CASE WHEN score >= 9 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS likelihood,
  position, same_identity, same_claim, same_payload, shared_entities, shared_words, round(hours_apart, 3) AS hours_apart, within
FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, coalesce(hours_apart, 9999), candidate_id) AS position FROM scored WHERE score >= 3) WHERE position <= 20""")
def duplicate_candidates_native(spark, sf):
    return Q.duplicate_candidates(_dup_input(spark, sf), with_ratio=False)


@register("duplicate_candidates")
def duplicate_candidates(spark, sf):
    """With the string ratio, which the oracle engine has no equal of; tested against a plain scan."""
    return Q.duplicate_candidates(_dup_input(spark, sf))
